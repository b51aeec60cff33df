"""Operator 8: personal data by candidate generation and gradient boosting.

Four base detectors (email, ip, card, phone) give spans by fixed rules. High-recall generators then propose further
spans, which may overlap: spelled-out addresses, digit groups of any shape, key-like tokens. Features of the format and
of the words around each go to gradient-boosted trees, whose calibrated scores select spans by a threshold a kind. Base
spans always stay; of the others the best scored that overlap none chosen before are added.

The trees are trained here on labelled examples that a seeded generator writes (``examples``): true formats in personal
contexts against order numbers, versions, dates, sums and hashes. Training is a second on the driver and the same
everywhere; the model is some kilobytes, whatever the data.

All offsets are code points. Each pattern is written so that it scans a text in linear time.
"""

from __future__ import annotations

import bisect
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import lengths_of, slices
from .common import table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("obfuscated_email", "national_id", "iban", "local_phone", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
SEED, ROUNDS, DEPTH, RATE, EXAMPLES, PRECISION, WINDOW, NOISE = 7, 40, 3, 0.2, 8000, 0.95, 40, 0.03

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 if d > 4 else d * 2 for d in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost non-overlapping within each kind; matches that fail their test are dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        else:
            end = max(end, at + 1)  # a local part ends at its own @, so nothing before this one can match later
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


_DOT = r"(?: ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?| (?:dot|DOT) |\.)"
_HOST = rf"[\w-]{{1,64}}(?:{_DOT}[\w-]{{2,24}}){{1,3}}(?!\w)"
#: Where a spelled-out address may have its at sign; what stands before is its local part.
_ATS = [re.compile(rf" at {_HOST}"), re.compile(rf" AT {_HOST}"), re.compile(rf" ?[\[({{<] ?(?:at|AT|@) ?[\])}}>] ?{_HOST}")]
_BEFORE = re.compile(r"[\w.+-]{1,64}\Z")
#: The other generators, wide on purpose.
_GENERATORS = [
    ("national_id", re.compile(r"(?<![\w.-])[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("local_phone", re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,8}){1,4}(?![\w-])")),
    ("secret", re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![\w/+-])")),
    ("secret", re.compile(r"(?<![\w/+.-])eyJ[A-Za-z0-9_-]{5,}+(?:\.[A-Za-z0-9_-]{4,}+){1,2}+(?![\w-])")),  # a token in parts, whole
]
#: How keys of well-known services begin, and tokens in parts. Fixed values, published by those services.
_PREFIX = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}\Z|sk_live_|sk_test_|ghp_|gho_|xox[abprs]-|AIza|glpat-|eyJ")
#: Words that speak for or against personal data.
_FOR = re.compile(r"(?i)phone|call|tel\b|mobile|contact|mail|write|reach|ssn|social|iban|account|bank|key|token|secret|password|passwd|api|auth|bearer|id\b|ring|fax|my number|number is|cell|text me|at home|credential")
_AGAINST = re.compile(r"(?i)order|version|invoice|isbn|page|total|sum|date|year|ticket|sku|part|build|commit|sha|checksum|serial|model|lot|no\.|chapter|figure|table|score|ratio|since|between|from|code|item|file|path")


def _entropy(s: str) -> float:
    counts = [s.count(c) for c in set(s)]
    return -sum(n / len(s) * math.log2(n / len(s)) for n in counts)


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) > 4 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s, before, after = text[start:end], text[max(0, start - WINDOW) : start], text[end : end + WINDOW // 2]
    digits, letters, upper = sum(map(str.isdigit, s)), sum(map(str.isalpha, s)), sum(map(str.isupper, s))
    near = before[-16:]
    return [
        float(ADDED_KINDS.index(kind)), len(s), digits, letters, upper, len(s) - digits - letters, len(re.split(r"[ ./-]", s)),
        _entropy(s), float(bool(_FOR.search(before))), float(bool(_FOR.search(near))), float(bool(_AGAINST.search(before))),
        float(bool(_AGAINST.search(near))), float(bool(_FOR.search(after))), float(near.rstrip().endswith((":", "="))),
        float("[" in s or "(" in s or "{" in s), float(" at " in s.lower()), float(" dot " in s.lower()), float("@" in s),
        float(kind == "iban" and s.replace(" ", "").isascii() and _mod97(s)), float(digits > 0 and letters > 0 and upper not in (0, letters)),
        float(bool(_PREFIX.match(s))), float(s.count("-")), float(digits == 0), float(bool(re.fullmatch("[0-9a-f]+", s))),
    ]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose."""
    out, digits = [], re.search(r"[0-9]", text)
    for k, anchor in enumerate(_ATS):
        if (" at ", " AT ")[k] in text if k < 2 else any(c in text for c in "[({<"):
            for m in anchor.finditer(text):
                if local := _BEFORE.search(text, max(0, m.start() - 64), m.start()):
                    out.append(("obfuscated_email", local.start(), m.end()))
    for k, pattern in _GENERATORS:
        if digits if k != "secret" else max(map(len, text.split()), default=0) >= 20:
            out += [(k, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, start, end, label): labelled candidates in made-up sentences."""
    import random

    r, out = random.Random(seed), []
    word = lambda a, b, s="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(s) for _ in range(r.randint(a, b)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join(word(2, 9) for _ in range(r.randint(0, 6)))

    def iban():
        body = num(r.choice([12, 14, 18]))
        check = 98 - int(body + "131400") % 97
        flat = f"DE{check:02d}{body}"
        return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if r.random() < 0.6 else flat

    def email(at, dot):
        return f"{word(3, 9)}{at}{word(3, 9)}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"

    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    good = [
        ("obfuscated_email", lambda: email(*r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), ("[at]", ".")])), ["mail me:", "contact", "write to", "reach me at", ""]),
        ("national_id", lambda: f"{num(3)}-{num(2)}-{num(4)}", ["ssn", "social security number:", "my id is", "SSN:", ""]),
        ("iban", iban, ["iban", "account:", "bank account", "pay to", ""]),
        ("local_phone", lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(7)}", f"0{num(3)}/{num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"]), ["call me:", "tel", "phone:", "mobile", "fax", "call", "my number is", "ring", "text me on", "reach me on", "cell:"]),
        ("secret", lambda: r.choice(["sk_live_", "ghp_", "", "xoxb-"]) + word(24, 40, mixed), ["api key:", "token =", "secret:", "password:", "bearer"]),
        ("secret", lambda: "AKIA" + word(16, 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ["key", "", "access key:", "the", "use"]),
        ("secret", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), ["token =", 'token = "', "api key:", "secret:", 'password = "']),
    ]
    bad = [
        ("obfuscated_email", lambda: f"{word(3, 8)} at {word(2, 8)}.{word(2, 6)}", ["arrived", "the", "was", "look", ""]),
        ("national_id", lambda: r.choice([num(9), f"{num(3)} {num(2)} {num(4)}"]), ["order", "part no.", "serial", "invoice", "total"]),
        ("iban", lambda: word(2, 2, "ABCDEFGHIJ") + num(2) + word(12, 12, "ABCDEFGH0123456789"), ["sku", "model", "build", "version", "part"]),
        ("local_phone", lambda: r.choice([f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)}/{num(2)}", f"{num(3)} {num(3)}", f"{num(4)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(7)}"]), ["date", "page", "order", "version", "year", "ticket", "part no.", "between", "score"]),
        ("local_phone", lambda: r.choice([f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}.{num(2)}", f"{num(4)} {num(4)}", f"{num(3)} {num(3)}"]), ["", "the", "call", "on", "write to"]),
        ("secret", lambda: r.choice([word(20, 34), num(24), word(20, 40, "-_"), word(4, 9) + "-" + word(5, 9) + "-" + word(6, 12), word(20, 30, "ABCDEFG"), word(40, 40, "0123456789abcdef")]), ["the", "word", "", "commit", "checksum", "sha"]),
    ]
    every = [w for _, _, words in good + bad for w in words]
    for i in range(n):
        kind, make, words = r.choice(good if i % 2 else bad)
        words = words if r.random() < 0.9 else every  # some stand in the wrong company
        head = f"{filler()} {r.choice(words)}".strip()
        text = f"{head} " if head else ""
        s = make()
        out.append((kind, f"{text}{s} {filler()}", len(text), len(text) + len(s), i % 2))
    # keys and tokens of any length, against long sums, rules, words and paths
    long_good = lambda k: r.choice(["", "eyJ", "ghp_", "sk_live_"]) + word(k, k, r.choice([mixed, mixed + "+/", mixed + "-_"]))
    long_bad = lambda k: r.choice([lambda: word(k, k, "0123456789abcdef"), lambda: num(k), lambda: r.choice("-_/+ax") * k, lambda: word(k, k), lambda: "/".join(word(3, 9) for _ in range(k // 7 + 3)), lambda: "-".join(word(3, 9) for _ in range(k // 7 + 3))])()
    for i in range(n // 8):
        s, words = (long_good if i % 2 else long_bad)(int(2 ** r.uniform(5, 12))), (good if i % 2 else bad)[-1][2]
        head = f"{filler()} {r.choice(words)}".strip()
        text = f"{head} " if head else ""
        if i % 4 == 1:  # the payload of a token in parts
            text, s = f"{text}eyJ{word(17, 60, mixed)}.", s + f"eyJ{word(10, 10, mixed)}"
        if i % 8 == 3:  # such a token whole
            s = f"eyJ{word(17, 60, mixed)}.eyJ{word(17, 200, mixed)}.{word(20, 60, mixed + '-_')}"
        out.append(("secret", f"{text}{s} {filler()}", len(text), len(text) + len(s), i % 2))
    return out


def grow(x, residual, weight, rows, depth: int):
    """A regression tree on columns of ``x`` for Newton steps: nested (feature, cut, left, right) or a value."""
    import numpy as np

    g, h = residual[rows].sum(), weight[rows].sum()
    leaf = float(g / (h + 1.0))
    if depth == 0 or len(rows) < 20:
        return leaf
    best, own = None, g * g / (h + 1.0)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v = x[order, f]
        gl, hl = np.cumsum(residual[order])[:-1], np.cumsum(weight[order])[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - own
        gain[v[1:] == v[:-1]] = -1
        if len(gain) and (best is None or gain.max() > best[0]):
            k = int(gain.argmax())
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best is None or best[0] <= 1e-6:
        return leaf
    _, f, c = best
    left = x[rows, f] <= c
    return (f, c, grow(x, residual, weight, rows[left], depth - 1), grow(x, residual, weight, rows[~left], depth - 1))


def tree_value(tree, x):
    import numpy as np

    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, c, a, b = tree
    return np.where(x[:, f] <= c, tree_value(a, x), tree_value(b, x))


def score(model: dict, x):
    """Calibrated probabilities."""
    import numpy as np

    raw = sum((RATE * tree_value(t, x) for t in model["trees"]), np.full(len(x), model["start"]))
    a, b = model["calibration"]
    return 1 / (1 + np.exp(-(a * raw + b)))


def lower_bound(hits, z: float = 1.645) -> float:
    """Wilson's lower bound of a share, from its single cases."""
    n, share = len(hits), hits.mean()
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def train(seed: int = SEED) -> dict:
    """Trees, Platt calibration and thresholds: the lowest score from 0.5 up at which the lower confidence bound (Wilson,
    95 %) of the precision on held-out examples of the kind is ``PRECISION`` or more.

    A share ``NOISE`` of the fitted labels is turned round, so that scores of easy examples do not crowd at 0 and 1.
    """
    import numpy as np

    rows = [e for e in examples(seed=seed) if (e[0], e[2], e[3]) in candidates(e[1])]
    x = np.array([features(k, t, s, e) for k, t, s, e, _ in rows])
    y = np.array([e[4] for e in rows], float)
    held = np.random.default_rng(seed).random(len(rows)) < 0.3
    fit = np.flatnonzero(~held)
    true, y = y, np.where(~held & (np.random.default_rng(seed + 1).random(len(y)) < NOISE), 1 - y, y)
    mean = y[fit].mean()
    model = {"start": math.log(mean / (1 - mean)), "trees": [], "calibration": (1.0, 0.0)}
    raw = np.full(len(y), model["start"])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        model["trees"].append(grow(x, y - p, p * (1 - p), fit, DEPTH))
        raw += RATE * tree_value(model["trees"][-1], x)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * raw[held] + b)))
        d, w = p - y[held], np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(w * raw[held] ** 2).sum() + 1, (w * raw[held]).sum()], [(w * raw[held]).sum(), w.sum() + 1]])
        step = np.linalg.solve(m, np.array([(d * raw[held]).sum() + (a - 1), d.sum() + b]))
        a, b = a - step[0], b - step[1]
    model["calibration"] = (float(a), float(b))
    p, kinds, y = score(model, x), np.array([e[0] for e in rows]), true
    model["thresholds"] = {}
    for k in ADDED_KINDS:
        at = held & (kinds == k)
        cuts = [0.5, *sorted(c for c in set(p[at]) if c > 0.5)]
        right = [c for c in cuts if (at & (p >= c)).any() and lower_bound(y[at & (p >= c)]) >= PRECISION]
        model["thresholds"][k] = float(right[0]) if right else 1.1
    model["held_out_accuracy"] = float(((p >= 0.5) == y)[held].mean())
    return model


def choose(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]], scores, thresholds: dict) -> list[tuple[str, int, int]]:
    """Candidates above their threshold that overlap no base span and none chosen before, best score first."""
    starts, taken = [], []

    def free(s: int, e: int) -> bool:
        at = bisect.bisect_left(starts, e)  # taken added spans are disjoint, so only the nearest can reach into [s, e)
        return not at or taken[at - 1][1] <= s

    covered = []  # union of the base spans
    for _, s, e in sorted(base, key=lambda b: b[1:]):
        if covered and s <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(covered[-1][1], e))
        else:
            covered.append((s, e))
    starts, taken, out = [s for s, _ in covered], covered, []
    passed = sorted(((p, c) for p, c in zip(scores, found) if p >= thresholds[c[0]]), key=lambda z: (KINDS.index(z[1][0]), z[1][1], -z[1][2]))
    whole, last = [], None  # of candidates of one kind, one within another gives way to it
    for p, c in passed:
        if last is None or c[0] != last[0] or c[2] > last[2]:
            whole.append((p, c))
            last = c
    for p, (k, s, e) in sorted(whole, key=lambda z: (-z[0], z[1][1], KINDS.index(z[1][0]))):
        if free(s, e):
            at = bisect.bisect_left(starts, s)
            starts.insert(at, s)
            taken.insert(at, (s, e))
            out.append((k, s, e))
    return out


def spans(texts: list[str | None], model: dict) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, each span (kind, start, end) by start, then kind. Null texts have none."""
    import numpy as np

    base = [base_spans(t or "") for t in texts]
    found = [candidates(t or "") for t in texts]
    x = [features(k, t, s, e) for t, own in zip(texts, found) for k, s, e in own]
    scores, at, out = score(model, np.array(x)).tolist() if x else [], 0, []
    for b, own in zip(base, found):
        more = choose(b, own, scores[at : at + len(own)], model["thresholds"]) if own else []
        at += len(own)
        out.append((b, sorted(b + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap, their union by the first's kind."""
    out, at, open_ = [], 0, None
    for kind, s, e in found:
        if open_ and s < open_[2]:
            open_ = (open_[0], open_[1], max(open_[2], e))
            continue
        if open_:
            out += [text[at : open_[1]], f"[{open_[0].upper()}]"]
            at = open_[2]
        open_ = (kind, s, e)
    if open_:
        out += [text[at : open_[1]], f"[{open_[0].upper()}]"]
        at = open_[2]
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of each row of ``docs``: arrays of (kind, start, end) by start, then kind, then end.

    A row with null or empty text has no spans, a null id stays null, repeated rows are rows each, texts of any length
    are read whole, some million characters at a time unless one text is longer. Other columns are ignored, whatever
    their names; an empty table gives an empty result. Added spans that score alike are taken by start, then kind.
    """
    model = train()
    kind = "array<struct<kind:string,start:int,stop:int>>"

    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            texts = b.column("text")
            for s, e in slices(lengths_of(texts)):
                both = spans(texts.slice(s, e - s).to_pylist(), model)
                cols = [pa.array([[dict(zip(("kind", "start", "stop"), s)) for s in x[i]] for x in both], kinds) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, e - s), *cols], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {kind}, spans {kind}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs``, all columns and rows, with personal data in ``text`` replaced and ``n_chars``, if there, adjusted.

    Null texts stay null, empty ones empty; repeated rows change alike; an empty table gives an empty result.
    """
    model = train()

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        rows, out = list(texts), []
        for s, e in slices([len(t or "") for t in rows]):
            out += [None if t is None else redact(t, found[1]) for t, found in zip(rows[s:e], spans(rows[s:e], model))]
        return pd.Series(out, dtype=object)

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
