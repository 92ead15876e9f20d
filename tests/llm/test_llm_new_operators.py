"""Mixing, fill-in-middle and the prefix trie: odd input, brute force, and the claims their docstrings make."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from answerloom.llm import fill_in_middle, mixing, prefix_trie, queries

DOCS = "doc_id long, text string, source string"
TALKS = "conv_id long, turn long, role string, text string"
CLASHING = ("size", "key", "weight", "part", "cut", "before", "form", "n", "epoch", "head", "place", "digest", "depth")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def with_clashes(df):
    return df.withColumns({name: F.lit(f"own {name}") for name in CLASHING if name not in df.columns})


# Mixing


def sources(spark, sizes):
    """Documents of n words per source: {source: [n, ...]}."""
    rows, doc = [], 0
    for source, counts in sizes.items():
        for n in counts:
            rows.append((doc, " ".join(["w"] * n), source))
            doc += 1
    return with_clashes(spark.createDataFrame(rows, DOCS)).repartition(4)


def weights(spark, given):
    return spark.createDataFrame(list(given.items()), "source string, weight double")


def test_targets_stop_at_their_caps(spark):
    rows = mixing.sized(sources(spark, {"a": [10] * 3, "b": [10] * 100, None: [5], "d": [10] * 30}))
    given = mixing.cyclic_weights(rows)
    assert {r.source: r.weight for r in given.collect()} == {"a": 1.0, "b": 2.0, "d": 3.0, None: 1.0}
    found = {r.source: r.target for r in mixing.targets(rows, given).collect()}
    # 1335 words: a and NULL are full at 90 and 15; b and d would get 492 and 738 of the rest.
    assert found == pytest.approx({"a": 90.0, None: 15.0, "b": 492.0, "d": 738.0})


def test_every_source_full(spark):
    rows = mixing.sized(sources(spark, {"a": [10], "b": [20]}))
    found = {r.source: r.target for r in mixing.targets(rows, mixing.cyclic_weights(rows), budget=1000, most=2).collect()}
    assert found == {"a": 20.0, "b": 40.0}


def test_mix_meets_targets_within_half_a_document(spark):
    rng = random.Random(1)
    docs = sources(spark, {s: [rng.randint(0, 200) for _ in range(n)] for s, n in (("a", 400), ("b", 60), ("c", 900))})
    rows = mixing.sized(docs)
    got = mixing.mix(rows, mixing.mixing_plan(rows, weights(spark, {"a": 5.0, "b": 1.0, "c": 1.0}))).collect()
    assert len(got) == 1360
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size <= 3 * r.size
    for source in "abc":
        assert abs(taken[source] - target[source]) <= 100
    # Complete epochs first: copies of a source differ by one at most.
    for source in "abc":
        copies = {r.copies for r in got if r.source == source}
        assert max(copies) - min(copies) <= 1


def test_partitioning_does_not_change_the_mix(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    runs = [
        sorted(map(tuple, mixing.mixing_report(docs.repartition(n, "text"), labels).collect())) for n in (1, 7)
    ]
    assert runs[0] == runs[1]


def test_quality_weights_raise_the_chance(spark):
    docs = sources(spark, {"a": [10] * 4000})
    quality = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    rows = mixing.sized(docs, quality)
    got = mixing.mix(rows, mixing.mixing_plan(rows, weights(spark, {"a": 1.0}), budget=10_000)).filter("copies = 1").collect()
    even = sum(r.doc_id % 2 == 0 for r in got)
    # Sampling without replacement: p of a heavy one solves (1 - q^4 + 1 - q) / 2 = 1/4, about 0.39 against 0.11.
    assert len(got) == 1000 and 720 < even < 860


def test_mixed_documents_keep_rows_and_epochs(spark):
    docs = sources(spark, {"a": [10] * 10, "b": [10] * 90})
    mixed = mixing.mixed_documents(docs, weights(spark, {"a": 1.0, "b": 1.0})).collect()
    times = Counter((r.source, r.doc_id) for r in mixed)
    assert sum(times.values()) == 100 and {times["a", d] for d in range(10)} == {3}
    assert sorted(r.epoch for r in mixed if r.doc_id == 0) == [1, 2, 3]
    assert all(r.key == "own key" and r.text == " ".join(["w"] * 10) for r in mixed)


def test_odd_rows_in_a_mix(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "c", None), (None, "d e f", None), (None, None, "x"), (2, "", "y"), (3, " \n", "y")]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = mixing.mixing_report(docs, labels).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((1, 2), (1, 2), (1, 1), (None, 3), (None, 0), (2, 0), (3, 0)), key=str)
    assert {r.target for r in got if r.source_size == 0} == {0.0}
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mixing_report(empty, labels).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


# Fill-in-middle


def odd_texts(n=400):
    rng = random.Random(3)
    shared = ["".join(rng.choices("ab é🙂\n\t x", k=rng.randint(1, 900))) for _ in range(12)]
    texts = ["", " ", "\n", "a", " a", "a ", "   \x1f", "x" * 9000, " " * 9000, "ab " * 4000, "a" * 64, "a" * 65]
    return texts + ["".join(rng.choices(shared, k=rng.randint(1, 6))) for _ in range(n)]


def test_cuts_against_the_token_list():
    cache, rng = fill_in_middle.ChunkCache(limit=20_000), random.Random(4)
    for text in odd_texts():
        tokens = TOKEN.findall(text)
        table = fill_in_middle.CutTable(text, cache)
        assert table.tokens == len(tokens)
        for k in {0, len(tokens), *(rng.randint(0, len(tokens)) for _ in range(5))}:
            assert table.place(k) == len("".join(tokens[:k])), (text[:50], k)
    assert cache.hits and cache.bytes <= 20_000


def test_chunks_follow_content():
    rng = random.Random(5)
    shared = "".join(rng.choices("abcdefgh ", k=20_000))
    pieces = []
    for head in ("", "other words before it " * 9):
        text = head + shared
        ends = fill_in_middle.chunk_ends(fill_in_middle._codes(text))
        assert ends[-1] == len(text)
        lengths = [b - a for a, b in zip([0, *ends], ends)]
        assert max(lengths) <= fill_in_middle.LONGEST and min(lengths[:-1]) >= fill_in_middle.SHORTEST
        pieces.append({text[a:b] for a, b in zip([0, *ends], ends)})
    assert len(pieces[0] & pieces[1]) > 0.8 * len(pieces[0])


def test_middles_of_odd_rows(spark):
    texts = [None, *odd_texts(120), "holds <S> itself", "<P", "S>"]
    rows = [(k if k % 9 else None, t, "s") for k, t in enumerate(texts)] * 2
    docs = with_clashes(spark.createDataFrame(rows, DOCS)).repartition(3)
    got = fill_in_middle.fill_in_middle(docs).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n, r.form, r.prefix, r.middle, r.suffix, r.output))
    for doc, text, _ in rows:
        text = text or ""
        tokens = TOKEN.findall(text)
        h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        if not text or "<S>" in text or h3 % 100 >= 50:
            expected = (len(tokens), "plain", None, None, None, text)
        elif h4 % 100 < 80:
            expected = (len(tokens), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}")
        else:
            expected = (len(tokens), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")
        assert expected in by_id[doc]
    report = fill_in_middle.middle_report(docs).collect()
    whole = {hashlib.sha256((t or "").encode()).hexdigest() for t in texts}
    assert {r.restored_sha256 for r in report} == whole
    assert fill_in_middle.middle_report(spark.createDataFrame([], DOCS)).count() == 0


def test_a_long_text_is_cut_in_linear_time():
    cache = fill_in_middle.ChunkCache()
    text = "word " * 1_000_000
    assert fill_in_middle.cuts(text, 500_000, 3, cache)[0] == 1_000_001
    assert fill_in_middle.cuts("x" * 3_000_000, 1, 0, cache) == (1, 0, 3_000_000)


# The trie


def brute_trie(talks):
    """Nodes of {conv_id: [(role, text), ...]} from explicit prefixes."""
    members = defaultdict(list)
    for c, turns in sorted(talks.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = [c for c in ids if len(talks[c]) == len(node)]
        rows.append((
            ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), sum(len(x) == len(node) + 1 for x in below),
            sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in below) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def rows_of(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def random_talks(seed, n=160, longest=14):
    rng = random.Random(seed)
    turns = [("user", "hi"), ("assistant", "hällo 🙂"), ("user", ""), ("", "x"), ("u", "serhi")]
    start = [rng.choices(turns, k=longest) for _ in range(4)]
    talks = {}
    for c in rng.sample(range(-3, 1000), n):
        base = rng.choice(start)
        k = rng.randint(0, longest)
        talks[c] = base[:k] + rng.choices(turns, k=rng.choice((0, 0, 1, 3)))
    return talks


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    talks = {c: t for c, t in random_talks(seed).items() if t}
    rows = [(c, d, role, text) for c, turns in talks.items() for d, (role, text) in enumerate(turns)]
    table = with_clashes(spark.createDataFrame(rows, TALKS)).repartition(5)
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.short_turns(table))) == brute_trie(talks)


def test_rebuilt_conversations_of_odd_rows(spark):
    rng = random.Random(7)
    rows = []
    for c, turns in random_talks(3, 120, 8).items():
        rows += [(c, rng.choice([d, d, None]), role or None, text or None) for d, (role, text) in enumerate(turns)]
    rows += rng.sample(rows, 20) + [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    table = with_clashes(spark.createDataFrame(rows, TALKS)).repartition(4)
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    talks = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        talks[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    assert any(not t for t in talks.values())
    assert rows_of(prefix_trie.trie_report(table)) == brute_trie(talks)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    long = [(5000, d, "u", f"t{d}") for d in range(300)]
    rows = long + [(5001, *r[1:]) for r in long] + [(c, 0, "u", "same") for c in range(400)]
    got = rows_of(prefix_trie.prefix_trie(prefix_trie.short_turns(spark.createDataFrame(rows, TALKS))))
    assert len(got) == 302
    by_depth = {(r[0], r[1]): r for r in got}
    assert by_depth[0, 0][3:6] == (402, 2, 2) and by_depth[0, 1][3:5] == (400, 0)
    assert by_depth[5000, 300][3:7] == (2, 0, 1, 4) and by_depth[5000, 150][3:6] == (2, 1, 1)
    assert by_depth[0, 1][7] == hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()


def test_empty_trie_is_its_root(spark):
    empty = spark.createDataFrame([], TALKS)
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows_of(prefix_trie.trie_report(empty)) == [(None, 0, None, 0, 0, 1, 0, nothing)]


def test_blocks_are_refined_only_where_siblings_diverge(spark):
    rows = [(c, d, "u", f"t{d}") for c in range(30) for d in range(8)] + [(c, d, "u", f"x{d}") for c in (90, 91) for d in range(4)]
    rows += [(91, 4, "u", "y")]
    parts = prefix_trie.segments(prefix_trie.turn_blocks(prefix_trie.short_turns(spark.createDataFrame(rows, TALKS))))
    # The two first blocks diverge at the root: eight turns. The blocks after them have no sibling and stay whole.
    assert sorted(len(r.nodes) for r in parts.collect()) == [1] * 9 + [4]


@pytest.mark.parametrize("name", ["op11_source_mixing", "op13_prefix_trie"])
def test_sql_on_other_rows(spark, data, name, tmp_path):
    """The SQL again, with more than the given tables hold: NULL sources and turns, conversations in several hundreds."""
    rng = random.Random(11)
    docs = [(k, "w " * rng.randint(0, 60), rng.choice(["a", "b", None, "ä", "z"])) for k in range(300)] + [(None, "w", "a")]
    talks = [(c, rng.choice([0, 1, 2, None]), rng.choice(["u", None]), rng.choice(["x", "yy", None])) for c in rng.choices(range(700), k=3000)]
    labels = [(k, rng.randint(0, 1)) for k in range(0, 300, 2)]
    for table, rows, schema in (
        ("documents", docs, DOCS), ("conversations", talks, TALKS), ("labels", labels, "doc_id long, quality int"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    query, sql = queries.QUERIES[name]
    assert oracle.compare(query(spark, str(tmp_path)), con, sql) is None
