"""Operator 13: repair of a conversation's structure by error-correcting Earley parsing.

A weighted grammar says which sequences of roles a conversation may have. Beside its own terminals, error productions
let a row be deleted or given another role and let a row without text be inserted, each at a cost. A chart set after
each row holds the Earley items reached there, each with its minimum (cost, audit), where the audit is the text of the
edits so far; the completed chart yields the repair.

Two audits of equal cost at one place are never prefixes of each other: a letter's cost is fixed by the row it stands
for, and an insert adds to the cost. So the least audit of a whole is made of least audits of its parts, and a long
conversation is parsed in segments of at most ``SEGMENT`` rows, each from every state of the grammar that it can start
in. Segments of one conversation go to different tasks; one pass over the few states of each segment joins them.

Rows are put in order by one range shuffle (conversation, turn, role, text hash), which splits a conversation of any
length over tasks. What needs a text's meaning (faults, edits) runs on narrow rows. Inserts are put right before the row
they serve, or at the end: elsewhere they would cost as much and give a larger audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, table

SEGMENT = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: The role grammar: productions of each nonterminal, terminals in lower case. A nonterminal stands first in a body only, so
#: every Earley item starts where the parse starts: its origin is that place, and a chart set has a few items at any length.
GRAMMAR = {"Conversation": [(), ("Whole",)], "Whole": [("Half", "a")], "Half": [("u",), ("System", "u"), ("Whole", "u")], "System": [("s",)]}
START = "Conversation"
#: What has been read so far: nothing, or what a production goes on from.
STATES = ("", "System", "Half", "Whole")
#: Roles that a row may be given, or inserted with, by terminal.
ROLES = {"u": "user", "a": "assistant"}
#: Scripts have a letter an edit: K keep, D delete, u or a rerole to, U or A insert. Audits write these as K, R, D, I.
LETTERS, INITIALS = "uaUA", "RRII"
WHITE = " \t\n\v\f\r"


def _following(item):
    head, k, dot = item
    body = GRAMMAR[head][k]
    return body[dot] if dot < len(body) else None


class Chart:
    """The Earley set after the rows read so far, from the grammar's state ``start``.

    ``items``: (head, production, dot) -> least (cost, audit, script). Only items that wait for a terminal and whole
    conversations are kept; what waits for a nonterminal is the same in every set (``PREDICTED``).
    """

    #: Items of the first set that wait for a nonterminal: completion goes on from them.
    PREDICTED = {x: [(h, k) for h, bodies in GRAMMAR.items() for k, b in enumerate(bodies) if b[:1] == (x,)] for x in GRAMMAR}

    def __init__(self, start: str = ""):
        if start:
            first = [(h, k, 1) for h, k in self.PREDICTED[start]]
        else:
            first = [(h, k, 0) for h, bodies in GRAMMAR.items() for k, b in enumerate(bodies) if not b or b[0] not in GRAMMAR]
        self.items: dict = {}
        for item in first:
            self._put(self.items, item, (0, "", ""))

    def _put(self, items: dict, item, value) -> None:
        """Add an item if it is better than the one held; a completed one advances all that waits for its head."""
        if _following(item) is not None or item[0] == START:
            if item in items and items[item][:2] <= value[:2]:
                return
            items[item] = value
        if _following(item) is None:
            for h, k in self.PREDICTED[item[0]]:
                self._put(items, (h, k, 1), value)

    def _inserted(self) -> dict:
        """Items reached by inserts alone. They serve the next kept row or the end, and cross no deleted row."""
        found: dict = {}
        agenda = list(self.items.items())
        while agenda:
            (h, k, dot), (cost, audit, script) = agenda.pop()
            t = _following((h, k, dot))
            if t in ROLES:
                more: dict = {}
                self._put(more, (h, k, dot + 1), (cost + INSERT, audit + "I", script + t.upper()))
                for item, value in more.items():
                    if all(item not in x or value[:2] < x[item][:2] for x in (self.items, found)):
                        found[item] = value
                        agenda.append((item, value))
        return found

    def read(self, initial: str, must_go: bool, truncated: bool) -> None:
        """Go on over one row: its role's initial, whether it must be deleted, whether keeping it costs more."""
        new: dict = {}
        for item, (cost, audit, script) in self.items.items():
            self._put(new, item, (cost + DELETE, audit + "D", script + "D"))
        if not must_go:
            more = TRUNCATED if truncated else 0
            for items in (self.items, self._inserted()):
                for (h, k, dot), (cost, audit, script) in items.items():
                    t = _following((h, k, dot))
                    if t is not None and t == initial:
                        self._put(new, (h, k, dot + 1), (cost + KEEP + more, audit + "K", script + "K"))
                    elif t in ROLES:
                        self._put(new, (h, k, dot + 1), (cost + REROLE + more, audit + "R", script + t))
        self.items = new

    def states(self) -> dict:
        """State -> least (cost, audit, script) of what leads there."""
        out: dict = {}
        for (h, k, dot), value in self.items.items():
            t, body = _following((h, k, dot)), GRAMMAR[h][k]
            if t is not None and (dot or t in ROLES):
                state = body[0] if dot else ""
                out[state] = min(out.get(state, value), value)
        return out

    def whole(self):
        """Least (cost, audit, script) of a whole conversation, inserts at its end included."""
        return min(v for items in (self.items, self._inserted()) for i, v in items.items() if i[0] == START and _following(i) is None)


def repair_rows(rows: list[tuple[str, bool, bool]]) -> tuple[int, str, str]:
    """(cost, audit, script) of a short conversation of rows (initial, must go, truncated), without Spark."""
    chart = Chart()
    for row in rows:
        chart.read(*row)
    return chart.whole()


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows in their order, written: (conv_id, turn, role, text, c, blank, truncated, u), ``u`` a number that rises with it.

    Order: conversation, turn (nulls first), then role and the hash of the text. Null roles and texts are one space, null
    conversations are one conversation. Other columns are left out.
    """
    text = F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(WHITE))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.md5(text).alias("c"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    by = ["conv_id", "turn", "role", "c", "tie"]
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("u", F.monotonically_increasing_id()))


def _groups(batches, *names: str):
    """Rows as tuples of lists by name, grouped where the first two columns (conversation, segment) stay the same."""
    held, key = [], None
    for b in batches:
        for row in zip(*[b.column(n).to_pylist() for n in names]):
            if held and row[:2] != key:
                yield key, held
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield key, held


#: Pairs of adjacent roles' initials that a conversation may have.
LEGAL = {"su", "ua", "au"}
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SEGMENT = "key string, seg long, first_u long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", head string, tail string, min_turn long, max_turn long, n_turns long, moves array<struct<start:string,end:string,cost:long,audit:string,script:string>>"
_JOINED = "key string, seg long, start string, end string, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, script string"


def _arrow(df: DataFrame, make, ddl: str, n: int = 1000) -> DataFrame:
    """``mapInArrow`` of a function from batches to dictionaries."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        import pyarrow as pa

        held = []
        for row in make(batches):
            held.append(row)
            if len(held) == n:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(run, ddl)


def _parsed(batches):
    for (key, seg), rows in _groups(batches, "key", "seg", "u", "turn", "initial", "blank", "duplicate", "truncated"):
        charts = [(s, Chart(s)) for s in STATES]
        for _, _, _, _, initial, blank, dup, trunc in rows:
            for _, chart in charts:
                chart.read(initial, blank or dup, trunc)
        initials, turns = [r[4] for r in rows], [r[3] for r in rows if r[3] is not None]
        yield {
            "key": key, "seg": seg, "first_u": rows[0][2], "blank": sum(r[5] for r in rows), "duplicate": sum(r[6] and not r[5] for r in rows), "truncated": sum(r[7] and not r[5] and not r[6] for r in rows),
            "illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1],
            "min_turn": turns[0] if turns else None, "max_turn": turns[-1] if turns else None, "n_turns": len(set(turns)),
            "moves": [{"start": s, "end": e, "cost": v[0], "audit": v[1], "script": v[2]} for s, chart in charts for e, v in chart.states().items()],
        }


def _joined(batches):
    """The best way through the segments of each conversation: a row a segment, and one of sums without segment.

    A state's rank is the place of its audit so far among those of all states; it settles ties, so no audit is kept."""
    tails = {s: Chart(s).whole() for s in STATES}
    names = ["key", "key", "seg", *_COUNTS, "head", "tail", "min_turn", "max_turn", "n_turns", "moves"]
    for (key, _), segments in _streams(batches, names):
        at, back, counts, last, low, high, n_turns = {"": (0, 0)}, [], [0] * 4, None, None, None, 0
        for _, _, seg, *own, head, tail, first_turn, last_turn, turns, moves in segments:
            best: dict = {}
            for m in moves:
                if m["start"] in at:
                    cost, rank = at[m["start"]]
                    best[m["end"]] = min(best.get(m["end"], (float("inf"),)), (cost + m["cost"], rank, m["audit"], m["start"]))
            order = sorted(best, key=lambda e: best[e][1:3])
            at = {e: (best[e][0], k) for k, e in enumerate(order)}
            back.append((seg, {e: v[3] for e, v in best.items()}))
            counts = [x + y for x, y in zip(counts, own)]
            counts[3] += last is not None and last + head not in LEGAL
            last = tail
            if first_turn is not None:
                n_turns += turns - (high == first_turn)
                low, high = first_turn if low is None else low, last_turn
        _, _, _, end = min((at[e][0] + tails[e][0], at[e][1], tails[e][1], e) for e in at)
        cost, script = at[end][0] + tails[end][0], tails[end][2]
        yield dict(zip(_COUNTS, counts)) | {"key": key, "gaps": 0 if low is None else high - low + 1 - n_turns, "cost": cost, "script": script}
        for seg, starts in reversed(back):
            yield {"key": key, "seg": seg, "start": starts[end], "end": end}
            end = starts[end]


def _streams(batches, names):
    """(key, iterator of rows) of runs of equal keys; a run is never held whole."""
    import itertools

    rows = (row for b in batches for row in zip(*[b.column(n).to_pylist() for n in names]))
    for key, run in itertools.groupby(rows, key=lambda r: r[:1]):
        yield (key[0], None), run


def parse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, sums) of ``ordered`` rows, conversations by their ``key`` (text of ``conv_id``).

    edits: (key, seg, first_u, script), the script of a segment's rows. sums: (key, gaps, blank, duplicate, truncated,
    illegal, cost, script), where the script is that of the inserts after the last row.
    """
    narrow = rows.select(F.col("conv_id").cast("string").alias("key"), "turn", "role", "c", "blank", "truncated", "u")
    firsts = cut(narrow.groupBy("key", "role", "c").agg(F.min("u").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.c") == F.col("b.c"))
    judged = narrow.alias("a").join(firsts.alias("b"), same, "left").select(
        "a.key", F.shiftright("u", SEGMENT.bit_length() - 1).alias("seg"), "u", F.col("turn").cast("long").alias("turn"), F.substring("a.role", 1, 1).alias("initial"), "blank", F.coalesce(F.col("u") > F.col("first"), F.lit(False)).alias("duplicate"), "truncated"
    )
    segments = cut(_arrow(judged.repartition("key", "seg").sortWithinPartitions("key", "seg", "u"), _parsed, _SEGMENT))
    joined = cut(_arrow(segments.drop("first_u").repartition("key").sortWithinPartitions("key", "seg"), _joined, _JOINED))
    release(firsts)
    chosen = joined.where("seg IS NOT NULL").select(F.col("key").alias("k"), F.col("seg").alias("s"), "start", "end")
    moves = segments.select("key", "seg", "first_u", F.inline("moves")).drop("cost", "audit")
    found = moves.alias("m").join(chosen.alias("c"), F.col("m.key").eqNullSafe(F.col("c.k")) & (F.col("m.seg") == F.col("c.s")) & (F.col("m.start") == F.col("c.start")) & (F.col("m.end") == F.col("c.end")))
    return cut(found.select("key", "seg", "first_u", "script")), joined.where("seg IS NULL").drop("seg", "start", "end")


def _letter(script: Column) -> Column:
    """Letters of a script as an array."""
    return F.regexp_extract_all(script, F.lit("."), F.lit(0))


def applied(rows: DataFrame, edits: DataFrame, sums: DataFrame) -> DataFrame:
    """Repaired rows (key, u, j, role, text, edit) of ``ordered`` rows; sort by (key, u, j). Deleted rows are not there."""
    role = lambda x: F.when(F.lower(x) == "u", F.lit(ROLES["u"])).when(F.lower(x) == "a", F.lit(ROLES["a"]))
    names = F.translate("x", LETTERS, INITIALS)
    of = F.regexp_extract_all("script", F.lit("[UA]*[KDua]"), F.lit(0))
    t = rows.withColumn("seg", F.shiftright("u", SEGMENT.bit_length() - 1)).withColumn("k", F.col("conv_id").cast("string"))
    met = t.join(edits, F.col("k").eqNullSafe(F.col("key")) & (t["seg"] == edits["seg"])).withColumn("own", of[(F.col("u") - F.col("first_u")).cast("int")])
    each = met.select("key", "u", "role", "text", F.posexplode(_letter(F.col("own"))).alias("j", "x")).where("x <> 'D'")
    kept = each.select("key", "u", "j", F.coalesce(role(F.col("x")), "role").alias("role"), F.when(F.col("x").isin("U", "A"), "").otherwise(F.col("text")).alias("text"), names.alias("edit"))
    last = sums.select("key", F.lit(2**63 - 1).alias("u"), F.posexplode(_letter(F.col("script"))).alias("j", "x"))
    return kept.unionByName(last.select("key", "u", "j", role(F.col("x")).alias("role"), F.lit("").alias("text"), names.alias("edit")))


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired conversations: (conv_id, place, role, text, edit), to be ordered by (conv_id, place).

    ``place`` is a struct that rises within a conversation. Empty tables give an empty result; a conversation of which
    nothing stays has no row; nulls, ties, repeats and extra columns as in ``ordered``. A conversation of any length is
    spread over tasks by its rows.
    """
    kind = conversations.schema["conv_id"].dataType
    rows = ordered(conversations)
    return applied(rows, *parse(rows)).select(F.col("key").cast(kind).alias("conv_id"), F.struct("u", "j").alias("place"), "role", "text", "edit")


def _hashes(batches):
    """SHA-256 of the rows of each key, joined by newlines: rows stream through, none is held."""
    import hashlib

    for (key, _), run in _streams(batches, ["key", "line"]):
        h, first = hashlib.sha256(), True
        for _, line in run:
            h.update((line if first else "\n" + line).encode("utf-8", "replace"))
            first = False
        yield {"key": key, "sha": h.hexdigest()}


def report(conversations: DataFrame, every: DataFrame) -> DataFrame:
    """Faults and repair of each conversation of ``every`` (column conv_id): (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256). One that has no rows in ``conversations`` has zeros and an empty repair.

    The audit is one text a conversation, as the report asks for, and so is the hash, which takes a conversation's
    repaired rows in turn through one task; neither holds the rows.
    """
    kind = every.schema["conv_id"].dataType
    rows = ordered(conversations)
    edits, sums = parse(rows)
    lines = applied(rows, edits, sums).select("key", "u", "j", F.concat("role", F.lit(":"), "text").alias("line"))
    hashes = _arrow(lines.repartition("key").sortWithinPartitions("key", "u", "j").select("key", "line"), _hashes, "key string, sha string")
    scripts = edits.select("key", "seg", "script").unionByName(sums.select("key", F.lit(2**63 - 1).alias("seg"), "script"))
    audits = scripts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "script"))), lambda x: x["script"]), "").alias("audit"))
    parts = every.select(F.col("conv_id").cast("string").alias("key")).distinct()
    for part in (sums.drop("script"), audits, hashes):
        parts = parts.unionByName(part, allowMissingColumns=True)
    got = parts.groupBy("key").agg(*[F.max(c).alias(c) for c in ("gaps", *_COUNTS, "cost", "audit", "sha")])
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return got.select(F.col("key").cast(kind).alias("conv_id"), *longs, F.translate(F.coalesce("audit", F.lit("")), LETTERS, INITIALS).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the query's contract puts in, by crc32 of ``conv_id:turn`` modulo 20."""
    space = F.lit(" ")
    at = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        "conv_id", "turn", F.when(at == 4, "user").otherwise(role).alias("role"), F.when(at == 1, "").when(at == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(at == 0, F.array().cast("array<int>")).when(at == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(damaged(conversations), conversations)
