"""Text as columns: lines, headings, paragraphs, sentences, names. All built-in expressions, no shuffle."""

from __future__ import annotations

import re
from functools import reduce
from html.entities import name2codepoint
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources import jvm
from . import values as V

#: White space of every script and the separators \x1c-\x1f, spelled out: a Java class of Unicode properties is many times slower.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and marks fail the two ranges in front; Java tries a class range by range.
SPACE = rf"[[^!-~\xa1-\u167f]&&[{_SPACE}]]"
#: Marks of the paragraph split; private-use characters, dropped from the text beforehand.
_BREAK, _HEAD = "", ""


def pattern(p: str, flags: str = "i") -> str:
    """A Java pattern with Unicode classes whose dot stops at line feeds alone."""
    return f"(?{flags}Ud){p}"


def hits(s: Column | str, p: str, flags: str = "i") -> Column:
    return F.rlike(s, F.lit(pattern(p, flags)))


def strip(s: Column | str) -> Column:
    return F.btrim(F.col(s) if isinstance(s, str) else s, F.lit(SPACES))


def collapse(s: Column | str) -> Column:
    """White space runs as one blank, none at the ends. Text whose white space is single blanks already is only looked through.

    ``s`` is read several times: a column, a variable of a lambda or of ``let``.
    """
    s = F.col(s) if isinstance(s, str) else s
    odd = rf"[[^ -~]&&[{_SPACE}]]"
    tidy = F.rlike(s, F.lit(rf"\A(?:[!-~]++ ?|[[^!-~]&&[^{_SPACE}]]++ ?)*+\z"))
    return F.trim(F.when(tidy, s).otherwise(F.regexp_replace(s, f"(?: (?={SPACE})|{odd}){SPACE}*", " ")))


def swapped(s: Column | str, pairs: dict[str, str]) -> Column:
    """With these replaced, in this order; a text that holds none is not rebuilt, which costs more than looking."""
    s = F.col(s) if isinstance(s, str) else s
    made = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), s)
    return F.when(reduce(lambda a, b: a | b, [F.contains(s, F.lit(k)) for k in pairs]), made).otherwise(s)


def nonempty(s: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(s, F.lit(""))


#: Single characters that end a line.
_ENDS = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def blank(text: Column | str) -> Column:
    """Whether there is nothing but white space; the first other character tells."""
    return ~F.rlike(text, F.lit(f"[^{_SPACE}]"))


def korean(text: Column | str) -> Column:
    return F.rlike(text, F.lit("[가-힣]"))


def raw_lines(text: Column | str) -> Column:
    """Lines by every Unicode line boundary; a boundary at the end opens no further line."""
    parts = r"[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
    ended = lambda x: reduce(lambda a, b: a | b, [F.endswith(x, F.lit(c)) for c in _ENDS])
    return let(swapped(text, {"\r\n": "\n"}), lambda x: F.split(F.when(ended(x), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x), parts))


def lines(text: Column | str) -> Column:
    return stripped_lines(raw_lines(text))


def stripped_lines(raw: Column | str) -> Column:
    return F.transform(raw, strip)


def is_heading(line: Column) -> Column:
    """Of a stripped line. What no heading begins with, in any case, is seen at its first letter."""
    return F.rlike(line, F.lit(r"\A[\p{Nd}\u2160-\u2188IVXivx\u0130\u0131\[<〈주핵kK\u212aaArR참국]")) & hits(line, V.HEADING)


def paragraphs(stripped: Column | str) -> Column:
    """array<struct<heading, text>>: headings by themselves; other lines joined up to a blank line or a heading."""
    clean = lambda x: swapped(x, {_BREAK: "", _HEAD: ""})
    mark = lambda x: F.when(x == "", F.lit(_BREAK)).when(is_heading(x), F.concat(F.lit(_BREAK + _HEAD), clean(x), F.lit(_BREAK))).otherwise(clean(x))
    pieces = F.transform(F.split(F.array_join(F.transform(stripped, mark), "\n"), _BREAK), lambda p: F.btrim(p, F.lit("\n")))
    bare = lambda p: F.when(F.startswith(p, F.lit(_HEAD)), F.substring(p, F.lit(2), F.length(p))).otherwise(p)
    as_row = lambda p: F.struct(F.startswith(p, F.lit(_HEAD)).alias("heading"), let(bare(p), lambda x: swapped(x, {"\n": " "})).alias("text"))
    return F.transform(F.filter(pieces, lambda p: p != ""), as_row)


def sentences(paragraph_rows: Column | str) -> Column:
    """Sentences of the paragraphs that are no headings, longer than 15 characters."""
    plain = F.filter(paragraph_rows, lambda p: ~p["heading"])
    # all paragraphs at once
    whole = let(F.array_join(F.transform(plain, lambda p: p["text"]), _BREAK), collapse)
    # replacing is faster than a pattern that looks behind every blank
    ends = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), [(f"{c} ", c + _BREAK) for c in ".!?"] + [(" " + _BREAK, _BREAK), (_BREAK + " ", _BREAK)], whole)
    return F.filter(F.split(ends, _BREAK), lambda s: F.length(s) > 15)


def limitations_section(paragraph_rows: Column | str) -> Column:
    """Paragraphs between the first heading on limitations and the next heading."""
    p = F.col(paragraph_rows) if isinstance(paragraph_rows, str) else paragraph_rows
    start = F.array_position(F.transform(p, lambda x: x["heading"] & hits(x["text"], V.LIMITATION_HEADING)), True)
    rest = F.slice(p, start.cast("int") + 1, F.size(p))
    end = F.array_position(F.transform(rest, lambda x: x["heading"]), True)
    return F.when(start > 0, F.when(end > 0, F.slice(rest, F.lit(1), end.cast("int") - 1)).otherwise(rest)).otherwise(F.filter(p, lambda x: F.lit(False)))


def cue(name: str) -> str:
    """All patterns of a cue class as one."""
    return "|".join(f"(?:{p})" for p in V.CUES[name])


def folded(text: Column | str) -> Column:
    """Lower case, with the letters that match s and i only when case is ignored."""
    return F.lower(swapped(text, dict(zip("ſıİ", "sii"))))


def lowered(p: str) -> str:
    """A pattern that matches folded text, case regarded, where ``p`` matches the text itself with case ignored: far faster in Java.

    A word at whose border the pattern begins is looked for first, and the border after it.
    """
    p = re.sub(r"\\[pP]\{[^}]*\}|\\.|[A-Z]", lambda m: m[0].lower() if len(m[0]) == 1 else m[0], p)
    return re.sub(r"^\\b([a-z]+)(?![a-z?*+{])", r"\1(?<=\\b\1)", re.sub(r"^\\b([a-z]+)(?=[a-z][?*+{])", r"\1(?<=\\b\1)", p))


def seen(low: Column | str, ps: list[str]) -> Column:
    """Whether one of the patterns matches, by the folded text."""
    return hits(low, "|".join(f"(?:{lowered(p)})" for p in ps), "")


#: Letters, the rare ones of European text first.
_RARE = "qxjkwzyvbfpghmucdltrosnaie"


def sought(word: str) -> str:
    """The part of a literal to look for: from its rarest letter on, since a search stops at each first letter; five letters at least."""
    starts = range(max(len(word) - 4, 1)) if word.isascii() and word.isalpha() else [0]
    return word[min(starts, key=lambda i: (_RARE.find(word[i]), i)) :]


def literal(p: str) -> str:
    """The longest run of letters, or an equals sign, that any match of a pattern holds; patterns stay simple enough to tell."""
    p = re.sub(r"\\[A-Za-z]", " ", re.sub(r"\(\?<?!.*?\)", " ", p))
    while (q := re.sub(r"\([^()]*\)[?*]?|\[[^]]*\][?*]?|\{[^}]*\}", " ", p)) != p:
        p = q
    return max(re.findall(r"[^\W\d_ ]+|=", re.sub(r"\w[?*]", " ", p)), key=lambda w: (len(w), w == "="), default="").lower()


def may_hit(low: Column | str, patterns: list[str], ko: Column | None = None) -> Column:
    """A cheap test on folded text that is true wherever a pattern matches; ``ko`` false says that no Korean letter occurs."""
    words = {literal(p) or (r"\d" if re.search(r"\\d(?![?*])", p) else "") for p in patterns}
    if "" in words:
        return F.lit(True)
    test = lambda w: F.rlike(low, F.lit(r"\p{Nd}")) if w == r"\d" else F.contains(low, F.lit(sought(w)))
    some = lambda ws: reduce(lambda a, b: a | b, [test(w) for w in sorted(ws)])
    own = {w for w in words if ko is not None and re.search("[가-힣]", w)}
    if not own:
        return some(words)
    return some(words - own) | (ko & some(own)) if words - own else ko & some(own)


def folded_rows(sentence_rows: Column | str) -> Column:
    return F.transform(sentence_rows, folded)


def matches(sentence_rows: Column | str, name: str, low: Column | str | None = None, ko: Column | None = None) -> Column:
    """Sentences of a cue class; ``low``, their folded forms, spares the pattern those that cannot have any (``ko`` as in ``may_hit``)."""
    if low is None:
        return F.filter(sentence_rows, lambda s: hits(s, cue(name)))
    low = F.col(low) if isinstance(low, str) else low
    return F.filter(sentence_rows, lambda s, i: may_hit(low[i], V.CUES[name], ko) & seen(low[i], V.CUES[name]))


def first(rows: Column) -> Column:
    return F.try_element_at(rows, F.lit(1))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used; lambdas share no subexpressions otherwise."""
    return F.transform(F.array(value), use)[0]


def _java(name: str, *args: Column) -> Column:
    """A function of ``Names.java``. A stream's batches run in a session of their own beside the one of tables: both know it."""
    active = SparkSession.getActiveSession()
    known = {id(x): x for x in (SparkSession._instantiatedSession, active) if x is not None}
    found = [jvm.functions(x, Path(__file__).with_name("Names.java"), {"Composed": "string", "Plain": "string"}) for x in known.values()]
    return F.call_function(found[0][name], *args)


def nfkc(name: Column | str) -> Column:
    """Compatibility composition; text of ASCII alone stays as it is."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(F.octet_length(name) == F.length(name), name).otherwise(_java("Composed", name))


def plain_name(name: Column | str) -> Column:
    """In compatibility composition, with the characters that HTML's references stand for; apostrophes that come from either are dropped.

    References: names of HTML 4, decimal and hexadecimal numbers, read in this order. An apostrophe of the name itself is a dash.
    """
    listed = "\n".join(f"{k}={v}" for k, v in sorted(name2codepoint.items()))
    read = lambda n: F.translate(_java("Plain", n, F.lit(listed)), "'", "")
    odd = lambda n: (F.octet_length(n) != F.length(n)) | F.contains(n, F.lit("&"))
    return let(swapped(name, {"'": "-"}), lambda n: F.when(odd(n), read(n)).otherwise(n))


def slug(name: Column | str) -> Column:
    """File name of a page: lower-case letters and digits of any script joined by dashes, whole words up to 120 characters."""
    s = let(F.lower(plain_name(name)), lambda s: F.when(F.contains(s, F.lit(",")), F.regexp_replace(s, r"(?<=\p{N}),(?=\p{N})", "")).otherwise(s))
    s = F.btrim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    room = lambda acc, w: F.lit(120) - F.length(acc) - F.length(w)
    # a word that does not fit is left out and later ones are tried; one that ends at 120 is the last
    step = lambda acc, w: F.when((acc != "") & ~F.endswith(acc, F.lit("-")), acc).when(room(acc, w) > 0, F.concat(acc, w, F.lit("-"))).when(room(acc, w) == 0, F.concat(acc, w)).otherwise(acc)
    fits = lambda s: let(F.btrim(F.aggregate(F.split(s, "-"), F.lit(""), step), F.lit("-")), lambda f: F.when(f != "", f).otherwise(F.substring(s, 1, 120)))
    return let(s, lambda s: F.when(s.isNull() | (s == ""), F.lit("untitled")).when(F.length(s) < 120, s).otherwise(fits(s)))


def wikilink(page_type: Column | str, name: Column, alias: Column | None = None) -> Column:
    return link(page_type, slug(name), name if alias is None else alias)


def link(page_type: Column | str, slug_: Column, alias: Column) -> Column:
    kind = F.lit(page_type) if isinstance(page_type, str) else page_type
    return F.concat(F.lit("[["), kind, F.lit("/"), slug_, F.lit("|"), alias, F.lit("]]"))


def short_ref(authors: Column, title: Column, source_id: Column, year: Column) -> Column:
    """First author up to a comma, with a mark if there are more; else title, else id; the year in brackets."""
    one = F.trim(F.split(F.try_element_at(authors, F.lit(1)), ",")[0])
    more = F.when(F.size(authors) > 1, F.when(F.rlike(one, F.lit("[가-힣]")), F.lit(" 외")).otherwise(F.lit(" et al."))).otherwise("")
    who = F.when(F.size(authors) > 0, F.concat(one, more)).otherwise(F.coalesce(nonempty(title), source_id))
    return F.concat(who, F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""))


def question_title(s: Column | str, limit: int = 50) -> Column:
    s = F.regexp_replace(strip(s), pattern(V.ORDINAL_PREFIX), "")
    s = F.regexp_replace(s, pattern(V.FUTURE_PREFIX), "")
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, limit), r"(?U)\s+\z", ""), F.lit("…")))


def url_key(url: Column | str) -> Column:
    return F.lower(F.rtrim(F.trim(url), F.lit("/")))


def title_key(title: Column | str) -> Column:
    return let(F.lower(title), collapse)
