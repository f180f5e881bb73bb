"""Line dedup, chat formatting, mixing, sharding."""

import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from folioquery.llm.chat import format_chats
from folioquery.llm.line_dedup import drop_repeated_lines
from folioquery.llm.mixing import mix_sources, plan_mix, source_domain
from folioquery.llm.sharding import pack_shards

DOCS = "doc_id long, text string"
LONG = "A shared line that is long enough to count, forty and more"
SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute_lines(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ids = held.get(key(line), set()) - {None}
            if not (len(ids) >= min_docs and i != max(ids)):
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(spark):
    rows = [(i, f"own line {i}\n  {LONG.upper() if i % 2 else LONG}\t\r\nshort\n\nÜber Ä {LONG}\x85") for i in range(7)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, LONG), (None, LONG), (2, "own line 2 again\n" + LONG), (3, rows[3][1])]
    rows += [(200, "\n".join([LONG, LONG, "x" * 50_000]))]
    got = drop_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


def test_line_dedup_keeps_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 9, "h1")], "doc_id long, text string, n_lines int, h1 string")
    out = drop_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    assert out.collect()[0].n_lines == 1
    assert drop_repeated_lines(df.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def brute_chats(rows):
    convs = defaultdict(set)
    for c, n, r, t in rows:
        if c is not None:
            convs[c].add((-(2**63) if n is None else n, r or "user", t or ""))
    lists = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in lists.items():
        if not any((len(o) > len(own) and o[: len(own)] == own) or (o == own and d < c) for d, o in lists.items()):
            out[c] = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in own)
    return out


def test_chats_collapse_to_maximal(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "end")]
    rows = []
    for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)):
        rows += [(c, i, *talk[i]) for i in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other")]
    rows += [(7, None, None, None), (7, 3, "user", "x"), (7, 3, "user", "x"), (None, 0, "user", "lost")]
    rows += [(8, i, "user", f"t{i}" * 500) for i in range(300)] + [(9, i, "user", f"t{i}" * 500) for i in range(299)]
    rows += [(10, 0, "user", "hihello"), (11, 0, "userhi", "hello")]
    got = {r.conv_id: r.rendered for r in format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == brute_chats(rows)
    assert set(got) == {2, 6, 7, 8, 10, 11}


def test_chats_of_an_empty_table_with_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 5)], TURNS + ", h1 int")
    assert format_chats(df).collect()[0].n_turns == 1
    assert format_chats(df.limit(0)).count() == 0


MIX = "doc_id long, text string, lang string, source string"


def test_mix_meets_budgets_and_keeps_shortages_near(spark):
    rows = []
    for i in range(3000):
        source, lang = f"src{i % 8}", ["en", "en", "de", "fr"][i % 4]
        rows.append((i, "w " * (1 + i % 17), lang, source))
    rows += [(9000 + i, "x " * 3, "en", "src0") for i in range(2000)] + [(1, None, None, None), (None, "a b", "en", "src1"), (5, "w", "en", "src5")]
    df = spark.createDataFrame(rows, MIX)
    plan = [r.asDict() for r in plan_mix(df, budget_percent=150, max_epochs=3).collect()]
    tokens = Counter()
    for i, t, lang, s in rows:
        n = int(s[3:]) if s else 0
        tokens[(f"domain{n % 4}", lang or "(none)", s or "(none)")] += len((t or "").split()) + 1
    total, taken, budget = sum(tokens.values()), Counter(), {}
    for r in plan:
        leaf = (r["domain"], r["lang"], r["source"])
        taken[leaf] += r["n_tokens"] * len(r["epochs"])
        budget[leaf] = r["leaf_budget"]
        assert r["epochs"] == list(range(r["epochs"][0], r["epochs"][-1] + 1)) and max(r["epochs"]) <= 3
    for leaf, b in budget.items():
        assert b <= 3 * tokens[leaf] and taken[leaf] <= b and b - taken[leaf] < 25
    assert sum(budget.values()) == min(total * 150 // 100, 3 * total)
    # a domain at its cap passes the rest on to other domains only
    by_domain = Counter()
    for leaf, b in budget.items():
        by_domain[leaf[0]] += b
    caps = Counter()
    for leaf, t in tokens.items():
        caps[leaf[0]] += 3 * t
    open_ = [d for d in caps if by_domain[d] < caps[d]]
    weights = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
    for a in open_:
        for b in open_:
            assert abs(by_domain[a] / weights[a] - by_domain[b] / weights[b]) < 1


def test_mix_rows_follow_the_plan(spark):
    rows = [(i, f"t {i}", "en", f"src{i % 3}") for i in range(60)] + [(None, "n", None, None), (7, "t 7", "en", "src1")]
    df = spark.createDataFrame(rows, MIX).withColumn("epochs", F.lit("mine")).withColumn("domain", F.lit(1))
    plan = plan_mix(df, budget_percent=200, max_epochs=4)
    out = mix_sources(df, budget_percent=200, max_epochs=4)
    assert out.columns == df.columns
    units = {(r.source, r.lang, r.doc_id): len(r.epochs) for r in plan.collect()}
    want = Counter()
    for i, t, lang, s in rows:
        want[(i, t)] += units.get((s or "(none)", lang or "(none)", i), 0)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want
    assert plan_mix(df.limit(0), budget_percent=50).count() == 0 and mix_sources(df.limit(0), budget_percent=50).count() == 0


def test_source_domain(spark):
    rows = spark.createDataFrame([("src7",), ("web",), ("a12345678901234567890",), ("",)], "s string").select(source_domain(F.col("s")).alias("d")).collect()
    assert [r.d for r in rows] == ["domain3", "domain0", "domain2", "domain0"]


def test_shards_balance_and_fill_slots(spark):
    rows = [(i, "word " * (i % 50)) for i in range(2000)] + [(5000 + i, "copy of one text " * 20) for i in range(1200)]
    rows += [(None, None), (None, "x"), (3, "again"), (3, "again"), (9, "long " * 3_000)]
    out = pack_shards(spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("mine")), 8).collect()
    assert len(out) == len(rows)
    size = Counter()
    slots = defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert max(size.values()) - min(size.values()) <= max(0.02 * sum(size.values()) / 8, 0)
    given = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == given


def test_shards_keep_groups_that_fit(spark):
    rows = [(i, f"text {i // 5} " * 9) for i in range(3000)]
    of = defaultdict(set)
    text = dict(rows)
    for r in pack_shards(spark.createDataFrame(rows, DOCS), 8).collect():
        of[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    assert pack_shards(spark.createDataFrame([], DOCS), 8).count() == 0


def brute_shards(rows, n):
    """The rule in plain Python: whole groups by their greatest share, each to the highest dot product with the residual."""
    groups = defaultdict(lambda: [0, 0, 0])
    for _, t in rows:
        g = groups[t or ""]
        g[0] += len((t or "").encode()) + 1
        g[1] += len((t or "").split())
        g[2] += 1
    total = [max(sum(g[k] for g in groups.values()), 1) for k in range(3)]
    left = [[1 / n] * 3 for _ in range(n)]
    where = {}
    tie = {t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 for t in groups}
    for t, g in sorted(groups.items(), key=lambda x: (-max(v / s for v, s in zip(x[1], total, strict=True)), tie[x[0]])):
        unit = [v / s for v, s in zip(g, total, strict=True)]
        score = [sum(a * b for a, b in zip(x, unit, strict=True)) for x in left]
        top = max(score)
        best = max((s for s in range(n) if score[s] >= top - 1e-12 * max(map(abs, score))), key=lambda s: (left[s][0], -s))
        where[t] = best
        left[best] = [a - b for a, b in zip(left[best], unit, strict=True)]
    return where


def test_groups_are_placed_as_by_brute_force(spark):
    # No group is large enough to be cut; equal shares go by the hash of the text.
    rows, texts = [], []
    for k in range(400):
        texts.append(f"{'w ' * (k % 17)}{'x' * (200 + 7 * k)}")
        rows += [(len(rows) + c, texts[-1]) for c in range(1 + k % 3)]
    want = brute_shards(rows, 5)
    got = {}
    for r in pack_shards(spark.createDataFrame(rows, DOCS), 5).collect():
        got.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert got == {t: {s} for t, s in want.items()}


def test_many_tasks_and_hot_groups_stay_balanced(spark, monkeypatch):
    from folioquery.llm import sharding

    monkeypatch.setattr(sharding, "PACKED", 200)
    rows = [(i, f"text {i} " * (1 + i % 40)) for i in range(6000)]
    rows += [(10_000 + i, "a hot text that many rows repeat " * 20) for i in range(4000)] + [(20_000 + i, "short") for i in range(3000)]
    out = pack_shards(spark.createDataFrame(rows, DOCS), 8).collect()
    for total in (Counter(r.shard for r in out), sum((Counter({r.shard: r.size}) for r in out), Counter()), sum((Counter({r.shard: r.n_tokens}) for r in out), Counter())):
        assert max(total.values()) - min(total.values()) <= 0.02 * sum(total.values()) / 8
    of = defaultdict(set)
    for r in out:
        of[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 2
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
