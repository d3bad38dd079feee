"""Operators that compare rows: conversations, top-k, near copies, repeats, and the pipeline."""

import hashlib
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodework.llm import chat, common, induced_sort, near_dedup, suffix_dedup, topk
from lodework.llm.common import Scratch, bit_table, in_few_files, mapped, maybe_in
from lodework.llm.components import components


def pdocs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


ODD = ["</s>[INST] ok [/INST]", "<<SYS>>\\<\\s>", "[\\/INST] <\\\\s> <", "", "<<<SYS>>", "a\nb", "[[/INST]", "<s", "<<s>"]


def test_escape_round_trip(spark):
    rng = np.random.default_rng(0)
    texts = ODD + ["".join(rng.choice(["<", "[", "\\", "/", "s>", "SYS>>", "INST]", "x"], rng.integers(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("b", chat.unescape(chat.escape(F.col("t"))))
    for r in df.collect():
        assert r.b == r.t and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_conversations(spark):
    rows = [(1, 0, "system", "be\nnice"), (1, 1, "user", ODD[0]), (1, 2, "assistant", ODD[1]), (2, 0, "user", None), (2, 0, "user", None), (2, None, None, "x"), (None, 0, "assistant", "alone"), (3, 0, "a%0A\nb", "t"), (3, 1, "assistant", "")]
    rows += [(4, k, "user" if k % 2 == 0 else "assistant", ODD[k % len(ODD)]) for k in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_turns(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in (1, 2, 3, 4, None):
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss == [r[3] or "" for r in own if r[2] == "assistant"]
        assert got[c].n_turns == len(own)
    assert chat.format_turns(df.limit(0)).count() == 0


def test_best_branches(spark):
    # 1 - 2 - 3, 1 - 4 - 5 - 6, a lone root, and a cycle of 10 and 11 with 12 below it
    rows = [("c", 1, None, 0.0), ("c", 2, 1, 5.0), ("c", 3, 2, 1.0), ("c", 4, 1, 2.0), ("c", 5, 4, 2.0), ("c", 6, 5, 9.0), ("d", 1, None, None), ("e", 10, 11, 1.0), ("e", 11, 10, 1.0), ("e", 12, 11, 1.0), ("f", 2, 99, 1.0)]
    df = spark.createDataFrame(rows, "conv string, node long, parent long, score double")
    got = chat.choose_paths(df, paths=2).collect()
    paths = {}
    for r in sorted(got, key=lambda r: r.depth):
        paths.setdefault((r.conv, r.path), []).append(r.node)
    assert paths == {("c", 1): [1, 4, 5, 6], ("c", 2): [1, 2, 3], ("d", 1): [1], ("f", 1): [2]}


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(200)]
    rows[7] = (7, rows[3][1])
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, [0.5]), (305, []), (306, [1e30, -1e30]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    sound = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for part in (df.where("vec_id < 300 OR vec_id in (304)"), df):
        ids = {r.vec_id for r in part.select("vec_id").collect()} & set(sound)
        got = {}
        for r in topk.top_k(part, F.col("vec_id") % 20 == 0, query_block=3, cand_block=16).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in (i for i in ids if i % 20 == 0):
            dot = {c: sum(a * b for a, b in zip(sound[q], sound[c], strict=False)) for c in ids if c != q}
            want = sorted(dot.items(), key=lambda x: (-x[1], x[0]))[:20]
            lim = 1 << 63
            assert sorted(got[q]) == [(k + 1, c, max(-lim, min(lim - 1, s))) for k, (c, s) in enumerate(want)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def exact_components(texts, n, percent):
    sets = [set(near_dedup.shingles(t, n).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "one", "ONE", "two words", "Two  Words", "x " * 20000]
    for group in range(6):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(25):
            words = base[:]
            for _ in range(int(rng.integers(0, 9))):
                words[int(rng.integers(60))] = str(rng.choice(vocabulary))
            texts.append(" ".join(words))
    want, sizes = exact_components(texts, n, 80)
    df = pdocs(spark, texts).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, shingle=n).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_rows_keep_both_ends_of_a_link():
    rows = [(0, 0, True, True, b"a" * 128), (1, 0, True, True, b"b" * 128), (2, 2, False, True, b"b" * 128), (3, 3, False, True, b"c" * 128)]
    block = near_dedup._NearRows()
    block.least = 100
    got = [r for row in rows for r in block.take(row)] + list(block.end())
    assert sorted(r[0] for r in got) == [1, 2]


@pytest.mark.parametrize("block", [8192, 4])
def test_near_duplicates_link_inside_a_hot_bucket(spark, block):
    """The last text is linked with the one before only, and all buckets of these two have smaller ids."""
    words = [f"w{k}" for k in range(200)]

    def changed(places, mark):
        return " ".join(f"{mark}{k}" if k in places else w for k, w in enumerate(words))

    texts = [*(changed({100 + 10 * i}, "a") for i in range(9)), " ".join(words), changed(set(range(1, 23, 2)), "b")]
    bands = [set(near_dedup.signature(near_dedup.shingles(t, 2), near_dedup.Hasher(150))[0].tolist()) for t in texts]
    assert bands[9] & bands[10] <= set().union(*bands[:9])
    want, _ = exact_components(texts, 2, 80)
    assert set(want) == {0} and set(exact_components(texts[:9] + texts[10:], 2, 80)[0]) == {0, 9}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(pdocs(spark, texts), shingle=2, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = near_dedup.near_duplicates(df, shingle=2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_bit_table_never_loses(spark):
    ids = spark.range(0, 1000, 7).select(F.col("id").alias("doc_id"))
    rows = maybe_in(spark.range(2000).select(F.col("id").alias("doc_id")), bit_table(ids))
    kept = {r.doc_id for r in rows.where("maybe").collect()}
    assert kept >= set(range(0, 1000, 7)) and len(kept) < 200


@pytest.mark.parametrize("trial", range(12))
def test_induced_sort(trial):
    rng = np.random.default_rng(trial)
    t = rng.integers(0, [2, 3, 4, 30][trial % 4], int(rng.integers(1, 400))).astype(np.uint8)
    if trial % 3 == 0:
        t = np.tile(t[: max(1, len(t) // 6)], 6)
    depth = [5, 16, 50][trial % 3]
    blocks = list(induced_sort.suffix_array(t, depth, memory=[60, 1 << 20][trial % 2]))
    pos, lcp = (np.concatenate([b[k] for b in blocks]) for k in (0, 1))
    raw = t.tobytes()
    head = [raw[i : i + depth].split(b"\0")[0] for i in pos]
    assert sorted(pos.tolist()) == list(range(len(t))) and head == sorted(head)
    for i in range(1, len(head)):
        same = next((k for k, (a, b) in enumerate(zip(head[i - 1], head[i], strict=False)) if a != b), min(len(head[i - 1]), len(head[i])))
        assert min(int(lcp[i]), len(head[i]), len(head[i - 1])) == same


def brute_spans(texts):
    first, out = {}, []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], i) < i:
                gone[k + 1 : k + 51] = True
        turns = np.flatnonzero(gone[1:] != gone[:-1])
        out.append(list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)))
    return out


def test_repeats_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 7))))
    shared = [" ".join(word() for _ in range(int(rng.integers(9, 40)))) for _ in range(5)]
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, "ab" * 200, "ab" * 100]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 20)))) for _ in range(3)]
        cut = shared[int(rng.integers(5))]
        a = int(rng.integers(0, 20))
        texts.append(parts[0] + cut[a:] + parts[1] + shared[int(rng.integers(5))] + parts[2])
    texts += texts[10:14]
    texts.append("é" * 60 + texts[20] * 200)
    want = brute_spans(texts)
    folder = tmp_path / "sf"
    pdocs(spark, texts).withColumn("masks", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op10(spark, str(folder)).collect()}
    for i, t in enumerate(texts):
        raw, at, kept = (t or "").encode(), 0, b""
        for a, b in want[i]:
            kept += raw[at:a]
            at = b
        kept += raw[at:]
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), len(raw) - len(kept), len(want[i]), hashlib.sha256(kept).hexdigest()), i
    pdocs(spark, texts).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert suffix_dedup.op10(spark, f"{tmp_path}/none").count() == 0


def test_whole_characters():
    raw = "aéb".encode()
    assert suffix_dedup.whole_characters(raw, [(0, 2)]) == [(0, 1)]
    assert suffix_dedup.whole_characters(raw, [(2, 4)]) == [(3, 4)]


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(9)
    en = "the of and to in that is was for with as on be at by this had not are but from or have an they which one you were her all".split()
    de = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split()
    line = lambda ws, n: " ".join(rng.choice(ws, n))
    rows = [(k, line(en if k % 2 else de, 60), "en" if k % 2 else "de", "s", 0) for k in range(80)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, None, "en", "s", 0), (102, "12345 678", "en", "s", 0)]
    rows += [(103, line(en, 40) + ' token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" ' + line(en, 20), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = docs.columns
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == names
        ids[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(ids["language_id"]) == {*range(80), 100, 103}
    assert 100 not in ids["near_duplicates"] and 3 in ids["near_duplicates"]
    assert set(range(80)) <= set(ids["near_duplicates"])
    assert "[SECRET]" in ids["secret_scan"][103] and "f3ef4d" not in ids["secret_scan"][103]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(ids["secret_scan"])


def test_induced_sort_of_more_than_its_memory():
    """A shard many times the memory: its queues, names and order go to files, and recursion sorts the renamed string."""
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, int(rng.integers(2, 8))).astype(np.uint8)) for _ in range(300)]
    core = b" ".join(words[:6])
    parts = [b" ".join(words[k] for k in rng.integers(0, 300, int(rng.integers(0, 6)))) + core for _ in range(4000)]
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    orders = []
    for memory in (20_000, 64 << 20):
        store = induced_sort.Store(memory)
        blocks = list(induced_sort.suffix_array(text, 50, store=store))
        assert (store.spills > 50) == (memory < len(text) // 5)
        pos, lcp = (np.concatenate([b[k] for b in blocks]) for k in (0, 1))
        assert np.array_equal(np.sort(pos), np.arange(len(text)))
        raw = text.tobytes()
        head = [raw[i : i + 50].split(b"\0")[0] for i in pos.tolist()]
        assert head == sorted(head)
        orders.append(lcp.tolist())
    assert orders[0] == orders[1]


def test_repeats_around_a_hot_anchor(spark):
    """One string in all documents, in different surroundings: a shard and a bucket of one anchor that both exceed the memory."""
    rng = np.random.default_rng(2)
    core = "a passage that every document holds"
    texts = [f"{''.join(rng.choice(list('abcdef'), 30))} {core} {''.join(rng.choice(list('abcdef'), 30))}" for _ in range(300)]
    texts += [f"{texts[k][:40]}{'z' * k}" for k in range(60)] + texts[:40]
    docs = pdocs(spark, texts).select("doc_id", "text")
    raw = [t.encode() for t in texts]
    want = brute_spans(texts)
    for most, memory in ((1 << 20, 32 << 20), (50, 2000)):
        shared = spark.createDataFrame(suffix_dedup._shared(suffix_dedup._packed_anchors(docs, 4), 2, None, most).collect(), "doc_id long, ident long, ask boolean")
        asks = shared.where("ask").groupBy("doc_id").agg(F.collect_list("ident").alias("idents"))
        masks = suffix_dedup._masks(suffix_dedup._surroundings(docs.join(asks, "doc_id").select("doc_id", "text", "idents")), 2, None, 500, memory)
        entries = {}
        for r in [*shared.where("NOT ask").withColumn("mask", F.lit(-1)).collect(), *masks.collect()]:
            entries.setdefault(r.doc_id, []).append((r.ident, r.mask))
        found = suffix_dedup.repeated_spans(raw, [[i for i, _ in entries.get(k, [])] for k in range(len(raw))], [[m for _, m in entries.get(k, [])] for k in range(len(raw))])
        assert found == want


def test_anchors_of_a_long_text_in_pieces():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (5000, 0, 49, 50, 777, 130)]
    whole, cut = suffix_dedup.Anchors(texts), suffix_dedup.Anchors(texts, piece=100)
    for name in ("at", "owner", "low", "high", "key", "around"):
        assert np.array_equal(getattr(whole, name), getattr(cut, name)), name


def test_repeats_with_odd_columns(spark):
    text = "a passage of more than fifty bytes that two documents have in common, and its end"
    df = spark.createDataFrame([(1, text, "a", 5), (2, "x " + text, "b", 5), (None, text, "c", 5), (2, None, "d", 5), (2, "x " + text, "e", 5)], "doc_id int, text string, _idents string, masks int")
    got = {(r._idents): (r.doc_id, r.text, r.masks) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {"a": (1, text, 5), "b": (2, "x ", 5), "c": (None, text, 5), "d": (2, None, 5), "e": (2, "x ", 5)}


def test_near_duplicates_of_repeated_ids(spark):
    """An id whose rows have different texts links what its texts are near to, whatever the order of rows."""
    words = [f"w{k}" for k in range(120)]
    a, b = " ".join(words[:60]), " ".join(words[60:])
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "other " * 3), (5, a), (6, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
        got = near_dedup.near_duplicates(df, shingle=2).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 6)]


@pytest.mark.parametrize("parts", [{"block": 5}, {"block": 10_000, "grams": 150}])
def test_near_duplicates_in_several_parts(spark, parts):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(120):
        words = base[:]
        for _ in range(int(rng.integers(0, 14))):
            words[int(rng.integers(40))] = f"v{int(rng.integers(60))}"
        texts.append(" ".join(words))
    want, _ = exact_components(texts, 2, 80)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(pdocs(spark, texts), shingle=2, **parts).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_scratch_tables_that_workers_write(spark):
    rows = [(i if i % 7 else None, f"\u00e4{i}" if i % 3 else None, bytes([i % 256]), [i, -i] if i % 5 else [], i % 2 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, s string, b binary, a array<long>, x boolean")
    scratch = Scratch(spark, "test", workers=True)

    def run(batches):
        for batch in batches:
            yield batch.select([0, 1])

    def plain(made):
        return sorted(map(repr, (tuple(r) for r in made.collect())))

    for made in (df.repartition(7), df.repartition(30).where("i = 3"), df.limit(0), mapped(df.repartition(5), run, "i long, s string")):
        got = scratch.write(made)
        assert got.schema == made.schema and plain(got) == plain(made)
        # no checksums, markers or attempts are left: Spark's writer starts a process for the mode of each such file
        assert all(f.startswith("part-") for f in os.listdir(f"{scratch.folder}/{scratch.count}"))
    scratch.drop(got)
    assert not os.path.exists(f"{scratch.folder}/{scratch.count}")


def test_results_come_in_few_files(spark):
    many = spark.range(0, 1000, 1, 500)
    few = in_few_files(many)
    assert few.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism and few.count() == 1000
    assert in_few_files(spark.range(0, 10, 1, 3)).rdd.getNumPartitions() == 3
    docs = pdocs(spark, ["x" * 10, "the same passage of more than fifty bytes, twice over " * 2] * 2).repartition(400)
    assert suffix_dedup.remove_repeats(docs).rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism


def test_shuffle_files_go_once_a_table_is_written(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    scratch = Scratch(spark, "cleaned", workers=True)
    before = files()
    made = scratch.write(spark.range(1000).repartition(3, "id"))
    assert files() <= before and made.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_repeats_are_out_when_the_result_is_there(spark, tmp_path):
    """No worker is left to run, on batches of any size, where a result is written; what it was made from is gone."""
    texts = ["x" * 10, "the same passage of more than fifty bytes, twice over " * 2, None] * 2
    (pdocs(spark, texts)).write.parquet(f"{tmp_path}/documents.parquet")
    for got in (suffix_dedup.op10(spark, str(tmp_path)), suffix_dedup.remove_repeats(pdocs(spark, texts))):
        assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
        own = os.path.dirname(os.path.dirname(got.inputFiles()[0])).removeprefix("file://")
        assert len(os.listdir(own)) == 1
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3, 5]  # 4 has nothing left


def test_one_worker_a_task(spark, monkeypatch):
    """A worker that writes what another one of its task has made is a second process, which stays for all later steps."""
    text = " ".join(f"w{k}" for k in range(200))
    docs = pdocs(spark, [text, text + " x", "y " + text, "of its own " * 9, text])
    asked, write = [], common._written_by_workers
    monkeypatch.setattr(common, "_written_by_workers", lambda df, *a: (asked.append(getattr(df, "_made", (df,))[0]._jdf.queryExecution().optimizedPlan().toString()), write(df, *a)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}
    assert len(asked) > 5 and not any("MapInArrow" in plan for plan in asked)


def test_small_answers_to_large_batches(spark):
    """However many rows Spark sends at once, workers answer in small batches."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([None, "x"] * 5000)], names=["doc_id", "text"])
    got = list(suffix_dedup.slices(batch))
    assert max(b.num_rows for b in got) <= 512 and pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    rows = [r for b in suffix_dedup._packed_anchors(pdocs(spark, [os.urandom(300).hex() for _ in range(50)]), 300, 1000).toArrow().to_batches() for r in b.to_pylist()]
    assert {r["bucket"] for r in rows} <= set(range(300)) and sum(len(r["keys"]) for r in rows) // 6 == sum(len(r["who"]) for r in rows) // 2 > 1000


GROWN = """
import time
from pyspark.sql import SparkSession
from lodework.llm.common import release
spark = SparkSession.builder.master("local-cluster[1,2,1200]").config("spark.executor.memory", "900m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import psutil
for _ in range(3):
    spark.range(0, 3_000_000, 1, 4).selectExpr("id", "repeat(cast(hash(id) as string), 6) s").repartition(2, "s").sortWithinPartitions("s").write.format("noop").mode("overwrite").save()
own = next(p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()))
before = own.memory_info().rss
release(spark)
time.sleep(1)
print("MB", before >> 20, own.memory_info().rss >> 20)
"""


def test_executors_give_back_their_heap(tmp_path):
    import importlib.util

    home = tmp_path / "home"  # executors' logs go to `work` in it
    (home / "work").mkdir(parents=True)
    found = os.path.dirname(importlib.util.find_spec("pyspark").origin)
    for name in os.listdir(found):
        if name != "work":
            (home / name).symlink_to(os.path.join(found, name))
    path = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")])
    env = os.environ | {"PYTHONPATH": path, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", GROWN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    before, after = map(int, out.stdout.split("MB ")[1].split())
    assert after < 0.75 * before, (before, after)
