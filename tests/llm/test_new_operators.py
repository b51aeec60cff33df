"""Collocations, exact duplicates and conversation repair beside brute force, with nulls, repeats, ties, empty tables and clashing columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lorebase.llm import collocations, conversation_repair, exact_dedup


def plain_collocations(rows, least, longest=5, share=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        if any(l2 == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (l2, v), b in cand.items()):
            continue
        cuts = [((1000 * a * n[lang]) // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    got = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        got += [(lang, i, *x[1:]) for i, x in enumerate(mine[:top], 1)]
    return sorted(got)


def test_collocations_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    bits = ["The", "the", "of", "cat", "É", "é", "sat", "on", "a", "mat", ",", ".", "\n", "\t", "  ", "!", "\x0b", "\xa0", "x'y", "漢", "🙂"]
    texts = [(rng.choice(["en", "fr", None, "und"]), " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    texts += [("en", "the cat sat on the mat by day")] * 9 + [("fr", None), (None, ""), ("en", " \t "), ("en", "word " * 20_000), ("en", "a a a a a a")]
    df = spark.createDataFrame([(*t, i, 0) for i, t in enumerate(texts)], "lang string, text string, piece long, m long")
    monkeypatch.setattr(collocations, "FLUSH", 50)  # many partial sums
    for least, share, top in ((5, 100, 2000), (3, 60, 7), (100, 100, None)):
        got = sorted(map(tuple, collocations.collocations(df, least, share=share, top=top).collect()))
        assert got == plain_collocations(texts, least, share=share, top=top) and got
    assert collocations.collocations(df.limit(0)).count() == 0


def test_collocations_with_a_full_bitmap_and_large_counts(spark, monkeypatch):
    """A bitmap in which all bits are set prunes nothing and changes nothing; products pass 64 bits."""
    texts = [("en", t) for t in ("a b c. a b", "b c a b", "c a b d")] * 4
    df = spark.createDataFrame(texts, "lang string, text string")
    want = plain_collocations(texts, 4)
    monkeypatch.setattr(collocations, "bitmap", lambda found: (8, b"\xff"))
    assert sorted(map(tuple, collocations.collocations(df, 4).collect())) == want
    monkeypatch.undo()
    big = 10**14

    def scaled(docs, least, longest):
        every, totals = frequent(docs, least, longest)
        return every.withColumn("f", F.col("f") * big), totals.withColumn("n", F.col("n") * big)

    frequent = collocations.frequent
    monkeypatch.setattr(collocations, "frequent", scaled)
    got = sorted(map(tuple, collocations.collocations(df, 4).collect()))
    assert [(x[0], x[2], x[-1]) for x in got] == [(x[0], x[2], x[-1]) for x in want] and got[0][3] >= 4 * big


def test_exact_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\t", "\n \n", "a b", "a  b", "a\tb", " a b", "a\xa0b", "a b ", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + "1", "é\x0bè", "é è", "é\x1cè", "漢 字" * 9000, "漢  字" * 9000]
    rows = [(i, rng.choice(texts)) for i in range(80)] + [(5, "a b"), (5, "a  b"), (5, "a b"), (None, "a b"), (None, "only"), (None, "only"), (7, "only once more")]
    df = spark.createDataFrame([(a, b, i % 3) for i, (a, b) in enumerate(rows)], "doc_id long, text string, SHA long")
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    ids = lambda g: [i for i in g if i is not None]
    want = Counter()
    for t, g in groups.items():
        keep = min(ids(g), default=None)
        first = True
        for i in sorted(g, key=lambda i: (i is None, i)):
            want[i, keep, len(g), first, hashlib.sha256(t.encode()).hexdigest()] += 1
            first = False
    for bits in (exact_dedup.BITS, exact_dedup.BUCKET):
        assert Counter(map(tuple, exact_dedup.duplicates(df, bits=bits, every=True).collect())) == want
    alone = {r["doc_id"]: r["sha"] for r in exact_dedup.duplicates(df).collect() if r["group_size"] == 1}
    assert 7 in alone and alone[7] is None  # its length shows that it is alone
    left = exact_dedup.drop_duplicates(df)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], norm(r["text"])) for r in left.collect()) == Counter((min(ids(g), default=None), t) for t, g in groups.items())
    assert exact_dedup.duplicates(df.limit(0)).count() == exact_dedup.drop_duplicates(df.limit(0)).count() == 0


def test_exact_dedup_runs_without_python(spark, data):
    from lorebase.llm import registry

    plan = registry.QUERIES["op12_exact_dedup"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


GOOD = re.compile("(s?(ua)+)?")


def plain_repair(rows):
    """Least (cost, audit, repaired) by a uniform-cost search over edit texts. rows: (role, text, must go, truncated)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if at == len(rows) and GOOD.fullmatch(initials):
            return cost, audit, list(out)
        nexts = []
        if at < len(rows):
            role, text, must, trunc = rows[at]
            more = 5 if trunc else 0
            nexts.append((cost + 2, audit + "D", at + 1, initials, out))
            if not must:
                nexts.append((cost + more, audit + "K", at + 1, initials + (role[:1] or "?"), (*out, (role, text))))
                nexts += [(cost + 1 + more, audit + "R", at + 1, initials + r[0], (*out, (r, text))) for r in ("user", "assistant")]
        nexts += [(cost + 5, audit + "I", at, initials + r[0], (*out, (r, ""))) for r in ("user", "assistant")]
        for x in nexts:
            if any(w.startswith(x[3]) for w in ("s" + "ua" * 12, "ua" * 12)):
                key = (x[2], len(x[3]) if len(x[3]) < 2 else 2 + len(x[3]) % 2, x[3][:1] == "s", x[1])
                if key not in seen:
                    seen.add(key)
                    heapq.heappush(heap, x)


def test_the_chart_finds_the_least_repair():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", " ", "tool", "undo", ""]
    for case in range(400):
        rows = [(rng.choice(roles[: 3 + 4 * (case % 2)]), f"t{i}", rng.random() < 0.15, rng.random() < 0.3) for i in range(rng.randint(0, 5))]
        cost, audit, out = plain_repair(rows)
        got = conversation_repair.repair_rows([(r[:1], m, t) for r, _, m, t in rows])
        assert (got[0], got[1]) == (cost, audit), rows
        assert len(got[2]) == len(audit) and sum(c != "D" for c in got[2]) == len(out)


def plain_report(rows, damage=True):
    """{conv_id: report} of (conv_id, turn, role, text) rows by plain Python and the brute-force repair."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if at:
            text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
            mine += [(turn, "user" if at == 4 else role, text)] * (2 if at == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, fixed = plain_repair([(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(mine, faults)])
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string"


def test_conversation_reports_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(150), None]:
        for turn in sorted(rng.sample(range(12), rng.randint(1, 6))):
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["system", "user", "user", "assistant", "assistant", None, "tool"]), rng.choice(["Hi.", "Hi.", "Yes!", "no end", "", " \n", None, "What? \n", "é.\x85", f"text {rng.random()}."])))
    rows += [rows[0]] * 3 + [(500, t, "user", "again.") for t in range(4)] + [(next(c for c in range(600, 9999) if zlib.crc32(f"{c}:1".encode()) % 20 == 0), 1, "user", "x")]
    df = spark.createDataFrame(rows, CONV).withColumn("Key", F.lit("clash")).withColumn("u", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.report(conversation_repair.damaged(df), df).collect()}
    assert got == plain_report(rows)
    assert conversation_repair.report(df.limit(0), df.limit(0)).count() == conversation_repair.repair(df.limit(0)).count() == 0


def test_long_conversations_in_segments_equal_one_parse(spark, monkeypatch):
    """One conversation of 3,000 rows and odd neighbours, over segments of 8 rows and several tasks."""
    monkeypatch.setattr(conversation_repair, "SEGMENT", 8)
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"{t}.", f"{t} open", "same.", ""])) for t in range(3000)] + [(c, t, "user", f"{t}.") for c in (0, 2) for t in range(3)]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    got = {r["conv_id"]: r for r in conversation_repair.report(df, df).collect()}
    seen, chart, n = set(), conversation_repair.Chart(), Counter()
    texts = []
    for _, t, role, text in rows[:3000]:
        fault = "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] != "." else ""
        seen.add((role, text))
        n[fault] += 1
        chart.read(role[0], fault in ("blank", "duplicate"), fault == "truncated")
    cost, audit, script = chart.whole()
    r = got[1]
    assert (r["cost"], r["audit"]) == (cost, audit) and (r["blank"], r["duplicate"], r["truncated"]) == (n["blank"], n["duplicate"], n["truncated"])
    at, names = iter(rows[:3000]), {"u": "user", "a": "assistant"}
    for x in script:
        if x in "UA":
            texts.append(f"{names[x.lower()]}:")
        else:
            _, _, role, text = next(at)
            texts += [] if x == "D" else [f"{names.get(x, role)}:{text}"]
    assert r["repaired_sha256"] == hashlib.sha256("\n".join(texts).encode()).hexdigest()
    fixed = sorted(conversation_repair.repair(df).where("conv_id = 1").collect(), key=lambda r: r["place"])
    assert [f"{r['role']}:{r['text']}" for r in fixed] == texts and {r["edit"] for r in fixed} <= set("KRI")


def test_registered_repair_equals_brute_force(spark, data):
    from lorebase.llm import registry

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op13_conversation_repair"](spark, data).collect()}
    assert got == plain_report(rows)
