"""The pipeline's rows against a plain computation of the same stages on a small corpus."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillstone.llm import decontam, simhash, toxicity
from quillstone.llm.queries import QUERIES

from .test_operators import prose, toxic_rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    root = str(tmp_path_factory.mktemp("sf"))
    items = [(k, prose(5000 + k, 25)) for k in range(5)]
    rows = [(i, t) for i, t, _ in toxic_rows(240)]
    labels = [(i, 1, y) for i, _, y in toxic_rows(240) if i % 3]
    for k in range(30):
        copy = rows[r.randrange(240)][1]
        rows.append((240 + k, copy if k % 2 else copy + " tail"))
    for k in range(10):
        rows.append((270 + k, prose(800 + k, 20) + " " + items[k % 5][1] + " " + prose(900 + k, 20)))
    rows += [(280, None), (281, ""), (282, prose(1, 4000))]
    docs = [(i, t, "en", f"src{i % 4}" if i % 5 else "hot", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, labels, items


def test_stages_against_brute_force(spark, tables):
    root, docs, labels, items = tables
    text = {d[0]: (d[1] or "") for d in docs}
    known = sorted((i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    model = toxicity.train([text[i].encode() for i, _ in known], [y for _, y in known])
    scorer = toxicity.Scorer(model.logits(), float(model.bias[1] - model.bias[0]))
    kept = [i for i in sorted(text) if scorer.score([text[i].encode()])[0] < 0.7]
    assert len(kept) < len(text)

    prints, first, up = {i: simhash.fingerprint(text[i].encode()) for i in kept}, [], {i: i for i in kept}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    first = [i for i in kept if top(i) == i]
    assert len(first) < len(kept)

    def leaks(t):
        w = decontam.fold(t.encode())
        for _, body in items:
            x = decontam.fold(body.encode())
            weights = Counter(decontam.shingles(x))
            if any(decontam.similarity(Counter(decontam.shingles(w[s : s + len(x)])), weights) >= 0.8 for s in range(len(w) - len(x) + 1)):
                return True
        return False

    clean = [i for i in first if not leaks(text[i])]
    assert len(clean) < len(first)

    stage = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{root}/documents.parquet")
    for name, want in (("toxicity", kept), ("near_dedup", first), ("decontamination", clean)):
        before = df.columns
        df = stage[name](spark, df, root)
        assert df.columns == before and sorted(r["doc_id"] for r in df.select("doc_id").collect()) == want
        assert {r["doc_id"]: r["text"] for r in df.collect()} == {d[0]: d[1] for d in docs if d[0] in set(want)}

    out = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, root).collect())
    lib, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for start, doc, n, crc in out:
        ids = lib.encode(text[doc], add_special_tokens=False).ids + [2]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert {d for _, d, *_ in out} <= set(clean) and max(Counter(d for _, d, *_ in out).values()) <= 2
    assert [d for _, d, *_ in out] == sorted(d for _, d, *_ in out)
    size = {i: len(text[i].split()) for i in clean}
    source = {d[0]: d[3] for d in docs}
    words = Counter()
    for _, d, *_ in out:
        words[source[d]] += size[d]
    for s in words:
        assert words[s] <= 2 * sum(size[i] for i in clean if source[i] == s)


def test_queries_have_their_columns(spark, tables):
    root = tables[0]
    want = {
        "op1_token_output": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op2_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
        "op3_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op5_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op6_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op8_media_columns": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op10_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op11_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op12_periodic_runs": {"doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
        "op13_phrase_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    }
    assert len(QUERIES) == 13
    for name, columns in want.items():
        df = QUERIES[name](spark, root)
        assert columns <= set(df.columns)
        if name in ("op5_token_counts", "op8_media_columns", "op10_secret_scan", "op11_quality_rules", "op12_periodic_runs"):
            assert df.count() == len(tables[1])


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _times int, _doc int, _kept int, _row_key long, size int, fingerprint string, taken long, score double"


def _rows(spark, texts):
    more = (1, 2, 3, 4, 5, "x", 6, 0.5)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *more) for i, t, s in texts], CLASHING)


def test_stages_with_null_and_repeated_ids_and_clashing_columns(spark, tables):
    root, _, _, items = tables
    long = prose(3, 300)
    texts = [(None, prose(60 + k, 40), "a") for k in range(3)] + [(1005, prose(70 + k, 40), "b") for k in range(3)] + [(1005, prose(70, 40), "b"), (None, prose(60, 40), None), (1007, long, "a"), (1008, long, "c"), (1009, None, "a"), (1010, "", "b"), (1011, "pre " + items[0][1] + " post", "a")]
    df = _rows(spark, texts).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["near_dedup"](spark, stage["toxicity"](spark, df, root), root)
    assert kept.columns == df.columns
    # One row of each text; equal texts and the two empty ones are copies, whatever their ids.
    want = {(None, prose(61, 40)), (None, prose(62, 40)), (1005, prose(70, 40)), (1005, prose(71, 40)), (1005, prose(72, 40)), (1007, long), (1009, ""), (1011, texts[-1][1]), (None, prose(60, 40))}
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter(want)
    clean = stage["decontamination"](spark, kept, root)
    assert clean.columns == df.columns and clean.count() == len(want) - 1
    mixed = stage["mixing"](spark, clean, root)
    assert mixed.columns == df.columns
    times = Counter((r["doc_id"], r["text"] or "") for r in mixed.collect())
    assert max(times.values()) <= 2 and (1009, "") not in times
    # Every source with words is near its target: 2 times its size at most, and within a document of it.
    size = {s: 0 for s in "abc"}
    for r in clean.collect():
        size[r["source"] or "c"] = size.get(r["source"] or "c", 0) + len((r["text"] or "").split())
    got = Counter()
    for r in mixed.collect():
        got[r["source"] or "c"] += len(r["text"].split())
    total = sum(size.values())
    assert abs(sum(got.values()) - 1.5 * total) <= 310
    out = stage["token_output"](spark, mixed, root).collect()
    assert len(out) == sum(times.values()) and sorted(r["start"] for r in out)[0] == 0
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])] == sorted((r["doc_id"] for r in out), key=lambda d: (d is not None, d or 0))


def test_stages_of_an_empty_table(spark, tables):
    df = _rows(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, tables[0])
        assert out.count() == 0
        if name != "token_output":
            assert out.columns == df.columns
