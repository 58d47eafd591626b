"""Vector collections, automata, resampling, snapshots, stateful ingest, traces, archives, co-citation: brute force and
failures between the steps."""

import io
import json
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import stats, terms
from quillstone.operators import cocitation as C
from quillstone.operators import similarity as S
from quillstone.operators import vectors as V
from quillstone.sources import archives, files, snapshots
from quillstone.stages import Stages, discard
from quillstone.streaming import ingest as I
from quillstone.streaming import trace


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- vectors ---


def plain_knn(queries, corpus, k, exclude):
    out = []
    for qid, q in queries:
        scored = sorted((-float(V.rounded(np.array([np.dot(q, c)]), 5)[0]), cid) for cid, c in corpus if not exclude or cid != qid)[:k]
        out += [(qid, cid, -s + 0.0, rank) for rank, (s, cid) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def space(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8)) * 4
    data = [(i, (centres[i % 6] + 0.2 * r.normal(size=8)).round(2).tolist()) for i in range(700)]
    data += [(1000 + i, data[7][1]) for i in range(30)]  # ties
    odd = [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 8)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").repartition(5)
    return [(i, np.array(v)) for i, v in data], df


@pytest.mark.parametrize("exclude", [True, False])
def test_search_over_rows_and_blocks(spark, space, exclude, monkeypatch):
    data, df = space
    q = df.filter("vec_id % 9 = 7")
    want = plain_knn([x for x in data if x[0] % 9 == 7], data, 5, exclude)
    assert rows(S.knn(q, df, 5, "vec_id", "vec_id", exclude_self=exclude).select("qid", "cid", "score", "rank")) == want
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    blocks = V.vector_blocks(df, "vec_id", cells=6).cache()
    assert blocks.agg(F.sum("n"), F.max("n")).first()[:] == (730, 40)
    found, report = V.search_blocks(q, blocks, 5, "vec_id", exclude_self=exclude)
    assert rows(found.select("qid", "cid", "score", "rank")) == want
    total = report.agg(F.sum("blocks"), F.sum("skipped"), F.count(F.lit(1))).first()
    assert total[2] == len({x[0] for x in want}) and total[1] > 0.5 * total[0]  # six tight clusters: most blocks are passed over
    monkeypatch.setattr(V, "QUERY_BYTES", 600)  # several blocks of queries
    assert rows(V.search_blocks(q, blocks, 5, "vec_id", exclude_self=exclude)[0].select("qid", "cid", "score", "rank")) == want
    assert rows(S.knn(q, df, 5, "vec_id", "vec_id", exclude_self=exclude).select("qid", "cid", "score", "rank")) == want
    blocks.unpersist()


def test_search_of_little(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for q, c, n in ((none, one, 0), (one, none, 0), (one, one, 2)):
        assert S.knn(q, c, 3, "vec_id", "vec_id").count() == n
        assert V.search_blocks(q, V.vector_blocks(c, "vec_id"), 3, "vec_id")[0].count() == n
    assert S.knn(one.filter("vec_id = 1"), one, 9, "vec_id", "vec_id", exclude_self=False).count() == 2


def test_random_directions_lose_nothing(spark, monkeypatch):
    """No structure to prune by: the bound must still hold."""
    r = np.random.default_rng(8)
    data = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(500, 16)))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    found, _ = V.search_blocks(df.filter("vec_id < 20"), V.vector_blocks(df, "vec_id", cells=30), 7, "vec_id")
    assert rows(found.select("qid", "cid", "score", "rank")) == plain_knn([(i, np.array(v)) for i, v in data[:20]], [(i, np.array(v)) for i, v in data], 7, True)


# --- automata ---


def test_automaton_against_contains(monkeypatch):
    r = random.Random(2)
    for t in range(200):
        letters = "ab" if t % 2 else "abcé漢😀 "
        wanted = list({"".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 30))})
        texts = ["".join(r.choice(letters + "z") for _ in range(r.choice([0, 1, 5, 60, 9]))) for _ in range(r.randint(0, 12))]
        monkeypatch.setattr(terms, "PIECE", r.choice([3, 512]))
        monkeypatch.setattr(terms, "HELD", r.choice([20, 4 << 20]))
        text, place = terms.Automaton(wanted).found(texts)
        assert list(zip(text.tolist(), place.tolist(), strict=True)) == [(i, j) for i, s in enumerate(texts) for j, w in enumerate(wanted) if w in s]


def test_term_hits_and_pairs(spark, monkeypatch):
    texts = [(1, "she sells his shells"), (2, ""), (3, None), (4, "he" * 900 + "hers"), (4, "ushers"), (None, "his")]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    wanted = ["hers", "he", "she", "his", "", "he", "zzz", "s"]
    plain = list(dict.fromkeys(wanted))
    want = sorted(((i, [w for w in plain if t is not None and w in t]) for i, t in texts), key=repr)
    table = spark.createDataFrame([(w,) for w in [*wanted, None]], "term string")
    pairs = sorted({(i, w) for i, t in texts for w in plain if t and w and w in t}, key=repr)
    for most in (terms.AUTOMATON_BYTES, 150):  # one automaton, and several
        monkeypatch.setattr(terms, "AUTOMATON_BYTES", most)
        assert rows(terms.term_hits(df, wanted, "id", "t")) == want
        assert rows(terms.term_pairs(df, table, "id", "t")) == pairs
    assert terms.term_pairs(df, table.limit(0), "id", "t").count() == 0 and rows(terms.term_hits(df, [], "id", "t")) == sorted(((i, []) for i, _ in texts), key=repr)


# --- resampling and substrings ---


def test_intervals_are_those_of_resampling(spark):
    r = np.random.default_rng(4)
    v = (r.random(900) < 0.3).astype(float)
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], float(x), None if i % 5 else float(x) * 2) for i, x in enumerate(v)] + [(-1, None, None, None)], "id long, g string, v double, w double").repartition(6)
    got = {(q["group"], q["metric"]): q for q in stats.intervals(df, "id", {"v": F.col("v"), "w": F.col("w")}, "g", 800).collect()}
    assert set(got) == {(g, m) for g in ("a", "b", "null", "all") for m in "vw"}
    parts = {"all": np.ones(900, bool), "b": np.arange(900) % 3 == 0, "a": np.arange(900) % 3 != 0}
    for g, own in parts.items():
        mean, low, high = stats.bootstrap_numpy(v[own], 4000, 1)
        q = got[g, "v"]
        assert q["n"] == own.sum() and q["mean"] == pytest.approx(mean)
        assert abs(q["low"] - low) < 0.15 * (high - low) and abs(q["high"] - high) < 0.15 * (high - low)
    assert got["all", "w"]["n"] == 180 and got["null", "v"]["n"] == 0 and got["null", "v"]["mean"] is None and got["null", "v"]["low"] is None
    assert rows(stats.intervals(df.repartition(2), "id", {"v": F.col("v")}, None, 40)) == rows(stats.intervals(df, "id", {"v": F.col("v")}, None, 40))
    one = stats.intervals(df.filter("id = 1"), "id", {"v": F.lit(3.0)}, None, 10).first()
    assert (one["n"], one["mean"], one["low"], one["high"]) == (1, 3.0, 3.0, 3.0)
    plan = stats.intervals(df, "id", {"v": F.col("v")}, "g")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 2  # the sums, and the percentiles of them; never the rows


def table_lcs(a, b):
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for k, y in enumerate(b):
            now.append(last[k] + 1 if x == y else 0)
        last, best = now, max(best, *now)
    return best


def test_suffix_automaton_against_the_table():
    r = random.Random(6)
    for t in range(400):
        letters = ["a", "ab", "abc", "aé漢😀"][t % 4]
        a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2))
        assert stats.longest_common_substring(a, b) == table_lcs(a, b)
    long = "".join(r.choice("ab") for _ in range(20_000))
    assert len(stats.SuffixAutomaton(long).moves) <= 2 * len(long) and stats.longest_common_substring("x" + long[5:9000] + "y", long) == 8995


def test_lcs_filter_reads_whole_turns(spark):
    from quillstone.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    turns = {(q["conv_id"], q["turn"]): q["text"] or "" for q in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    users = [(q["conv_id"], q["turn"]) for q in spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'user'").collect()]
    got = {(q["conv_id"], q["turn"]): q["lcs"] for q in QUERIES["lcs_filter"](spark, sf).collect()}
    assert set(got) == set(users)
    for c, t in users[:40]:
        assert got[c, t] == table_lcs(turns[c, t], turns.get((c, t + 1), ""))


# --- stages and snapshots ---


def test_stage_tables_go_and_results_stay(spark, tmp_path):
    with Stages(spark, "t") as s:
        a = s.table(spark.range(5), "a")
        out = s.result(a.filter("id > 2"))
        path = a.inputFiles()[0].removeprefix("file://")
        assert a.count() == 5 and open(path, "rb").read(4) == b"PAR1"
    assert out.count() == 2
    with pytest.raises(FileNotFoundError):
        open(path, "rb")
    with pytest.raises(RuntimeError), Stages(spark, "t") as s:
        path = s.table(spark.range(5), "a").inputFiles()[0].removeprefix("file://")
        raise RuntimeError
    with pytest.raises(FileNotFoundError):
        open(path, "rb")
    discard(out)


def test_a_reader_sees_whole_tables_whenever_a_writer_stops(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root)
    assert snapshots.write(spark.range(5), root) == 1
    began = snapshots.read(spark, root)

    def stops(*_):
        raise OSError("the writer is lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_point", stops)
        with pytest.raises(OSError):
            snapshots.update(spark, root, lambda d: d.filter("id < 2"))
        assert snapshots.read(spark, root).count() == 5 and snapshots.current(spark, root)["number"] == 1
    assert snapshots.update(spark, root, lambda d: d.filter("id < 2")) == 2 and snapshots.read(spark, root).count() == 2
    assert began.count() == 5  # who began with the old version can finish
    assert snapshots.update(spark, root, lambda d: d) is None
    with pytest.raises(snapshots.Stale):
        snapshots.write(spark.range(9), root, base=1)
    assert snapshots.read(spark, root).count() == 2
    assert snapshots.vacuum(spark, root, 2) == 2 and len(snapshots.versions(spark, root)) == 2 and snapshots.vacuum(spark, root) == 1 and snapshots.read(spark, root).count() == 2


def test_tables_of_one_version_change_together(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    chunks = lambda n: spark.createDataFrame([(i, "t", [("act", i)]) for i in range(n)], "id long, text string, refs array<struct<law_name:string,article_no:int>>")
    files.write_tables(chunks(3), root)
    monkeypatch.setattr(snapshots, "_point", lambda *_: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        files.write_tables(chunks(7), root)
    assert snapshots.read(spark, root, "chunks").count() == snapshots.read(spark, root, "chunk_laws").count() == 3


# --- streams ---


def test_ingest_of_batches_with_repeats_and_a_replay(spark, tmp_path):
    src, root, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    text = lambda k: f"Text number {k} has some words that make a chunk of its own. " * 30
    schema = "doc_id long, text string"
    parts = [[(1, text(1)), (2, text(2)), (3, text(1))], [(4, text(2)), (5, text(3)), (6, None)], [(7, text(1)), (8, text(3)), (9, text(4)), (10, "")]]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        I.ingest(stream(), root, check).awaitTermination()  # the stream stops and starts again between the batches
        seen.append(I.batches(spark, root))
    whole = I.fresh_chunks(spark.createDataFrame([d for p in parts for d in p], schema))
    want = sorted(bytes(r["digest"]) for r in whole.collect())
    got = sorted(bytes(r["digest"]) for r in I.read_chunks(spark, root).collect())
    assert got == want and len(set(want)) == len(want) and len(seen[-1]) >= 3
    # A batch that runs again, and one that stops before its manifest.
    again = spark.read.parquet(f"{root}/rows/batch={seen[-1][0]}")
    assert I.put_batch(again, seen[-1][0], root) is False
    again.write.parquet(f"{root}/rows/batch=999")
    assert sorted(bytes(r["digest"]) for r in I.read_chunks(spark, root).collect()) == want
    with pytest.raises(FileNotFoundError):
        I.read_chunks(spark, str(tmp_path / "none"))


STEP = "qid string, hop int, tool string, confident boolean, done boolean"


def test_messages_arrive_once_and_in_order(spark, tmp_path):
    spark.dataSource.register(trace.TraceSink)
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [
        [("a", 1, "cases", True, False), ("b", 0, "rules", False, True), ("c", 0, "rules", None, False)],
        [("a", 0, "rules", False, False), ("a", 1, "cases", True, False), ("c", 1, "rules", False, False)],
        [("a", 2, "related", False, True), ("b", 0, "rules", False, True), (None, 0, "x", True, True), ("c", 3, "late", True, True)],
        [("c", 2, "rules", False, False)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, STEP).coalesce(1).write.mode("append").parquet(src)
        stream = trace.progress_stream(spark.readStream.schema(STEP).parquet(src))
        stream.writeStream.format("trace").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = trace.read_trace(spark, out).orderBy("qid", "batch", "hop").collect()
    told = {q: [(r["hop"], r["kind"], r["detail"]) for r in got if r["qid"] == q] for q in "abc"}
    assert told == {
        "a": [(0, "step", "rules"), (1, "step", "cases"), (2, "step", "related"), (3, "result", "")],
        "b": [(0, "step", "rules"), (1, "error", "")],
        "c": [(0, "step", "rules"), (1, "step", "rules"), (2, "step", "rules"), (3, "step", "late"), (4, "result", "")],
    }
    # A commit that comes again names nothing anew; a part without a commit is not read.
    writer = trace._Writer(out)
    first = json.loads(next((tmp_path / "out/commits").glob("0*0.json")).read_text())["batch"]
    from pyspark.sql import Row

    part = writer.write(iter([Row(qid="a", hop=9, kind="step", detail="twice")]))
    assert trace.read_trace(spark, out).count() == len(got)
    writer.commit([part, None], first)
    assert trace.read_trace(spark, out).count() == len(got) and not (tmp_path / f"out/parts/{part.name}").exists()
    assert trace.read_trace(spark, str(tmp_path / "none")).count() == 0


# --- archives ---


def zipped(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_members_are_read_from_their_own_ranges(spark, tmp_path):
    inner = zipped([("deep.txt", b"deep"), ("more.ZIP", zipped([("deepest.txt", b"x" * 70_000)], zipfile.ZIP_STORED))])
    big = random.Random(1).randbytes(3 << 20)
    (tmp_path / "a.zip").write_bytes(zipped([("one.txt", b"one"), ("dir/", b""), ("dir/two.txt", big), ("in.zip", inner), ("bad.zip", b"no archive"), ("empty.txt", b"")]))
    damaged = bytearray(zipped([("x.txt", b"abc" * 1000), ("y.txt", b"fine")]))
    damaged[50] ^= 0xFF
    (tmp_path / "b.ZIP").write_bytes(bytes(damaged))
    (tmp_path / "c.zip").write_bytes(b"PK nothing")
    (tmp_path / "d.txt").write_bytes(b"no")
    found = archives.archive_paths(spark, str(tmp_path))
    assert found.count() == 3
    with Stages(spark, "unpack") as stages:
        got = {r["path"].split("/", 3)[-1].split(f"{tmp_path.name}/")[-1]: (r["content"] and bytes(r["content"]), r["error"]) for r in archives.unpack_archives(spark, found, stages).collect()}
    assert got["a.zip!one.txt"] == (b"one", None) and got["a.zip!dir/two.txt"] == (big, None) and not got["a.zip!empty.txt"][0] and got["a.zip!empty.txt"][1] is None
    assert got["a.zip!in.zip!deep.txt"] == (b"deep", None) and got["a.zip!in.zip!more.ZIP!deepest.txt"] == (b"x" * 70_000, None)
    assert got["a.zip!bad.zip"][1] == "bad_archive" and got["c.zip"][1] == "bad_archive" and got["b.ZIP!y.txt"] == (b"fine", None) and got["b.ZIP!x.txt"][1].startswith("corrupted")
    assert len(got) == 9
    members = archives.list_members(found.filter("path like '%a.zip'"))
    assert members.count() == 5 and archives._dealt(members).rdd.getNumPartitions() == 1
    # Members of one archive, dealt to several tasks.
    dealt = members.repartition(4, "source", "offset")
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1 and archives.read_members(dealt.filter("not nested")).filter("error is null").count() == 3
    with Stages(spark, "unpack") as stages:
        assert archives.unpack_archives(spark, found.limit(0), stages).count() == 0


# --- co-citation ---


def test_co_citation_moves_no_edge(spark):
    r = random.Random(1)
    edges = [(c, r.choice("ab"), str(r.randint(1, 9))) for c in range(40) for _ in range(r.randint(0, 6))] + [(99, "a", str(k)) for k in range(60)] + [(None, "a", "1"), (3, "a", None), (5, None, "4")]
    df = spark.createDataFrame(edges, "chunk_id long, law_name string, article string")
    C.write_edges(df, "test_edges", 4, hot=7)
    try:
        own = {e for e in edges if e[0] is not None and e[2] is not None}
        want = Counter((a, b, c, d) for (x, a, b) in own for (y, c, d) in own if x == y and (a, b) != (c, d))
        pairs = C.co_cited(spark, "test_edges")
        assert {tuple(q)[:4]: q[4] for q in pairs.collect()} == dict(want)
        plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Bucketed: true" in plan and plan[plan.index("SortMergeJoin") :].count("Exchange") == 0
        left, right = C.salted(df, 7)
        assert left.filter("chunk_id = 99").groupBy("salt").count().agg(F.max("count")).first()[0] < 20 and right.filter("chunk_id = 99").count() == 60 * 9
        q = spark.createDataFrame([(1, "3"), (2, "77"), (3, None)], "qid long, article string")
        got = C.related_laws(q, "test_edges", 4).orderBy("qid", "rank").collect()
        chunks = {x for x, _, b in own if b == "3"}
        together = Counter((c, d) for (y, c, d) in own if y in chunks and any((x, b) == (y, "3") and (a, b) != (c, d) for (x, a, b) in own))
        best = sorted(together.items(), key=lambda t: (-t[1], t[0][0] or "", t[0][1]))[:4]
        assert [(g["related_law"], g["related_article"], g["co_count"], g["n_chunks"]) for g in got if g["qid"] == 1] == [(c, d, n, len(chunks)) for (c, d), n in best]
        assert [(g["qid"], g["n_chunks"], g["rank"]) for g in got if g["qid"] > 1] == [(2, 0, None), (3, 0, None)]
        evidence = C.related_evidence(C.related_laws(q, "test_edges", 1)).collect()
        assert len(evidence) == 1 and evidence[0]["primary_law"] == f"{best[0][0][0]}第{best[0][0][1]}條"
    finally:
        C.drop_edges(spark, "test_edges")
