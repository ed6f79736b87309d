"""WARC archives, conversations and exact search: round trips, brute force and defined edge cases."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F


# ------------------------------------------------------------------ WARC


def pages(spark):
    big = "<p>é" + "x" * 300_000 + "</p>"
    rows = [(5, "http://a/5", big), (2, "http://a/2?q=ü\r\nX: y", big), (9, None, big), (1, "http://a/1", "small"), (3, "http://a/3", "small"), (4, "http://a/4", None), (6, "", ""), (7, "u", "y" * 100), (7, "u", "y" * 100), (8, "u", "y" * 100), (None, "n", "z" * 200), (10, "n", "z" * 200)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)


def test_archives_round_trip(spark, tmp_path):
    from pit_engine.llm.warc import plan_records, read_archives, write_archives

    rows, df = pages(spark)
    folder = f"file://{tmp_path}/warc"
    manifest = write_archives(plan_records(df), folder, chunk_bytes=10_000, archive_bytes=50_000)
    chunks = read_archives(manifest, chunk_bytes=7_000).collect()
    whole = {}
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        whole.setdefault((c.record_id, c.record_type, c.refers_to), []).append(c)
    assert max(len(c.data) for c in chunks) <= 7_000
    text = {i: (h or "").encode() for i, _, h in rows}
    for (i, kind, refers), cs in whole.items():
        last = [c for c in cs if c.is_last][0]
        assert last.payload_bytes == len(text[i]) and last.digest_so_far == hashlib.sha256(text[i]).hexdigest()
        if kind == "response" and i != 7:
            assert b"".join(bytes(c.data) for c in cs) == text[i]
            so_far = hashlib.sha256()
            for c in cs:
                so_far.update(bytes(c.data))
                assert c.digest_so_far == so_far.hexdigest()
    kinds = {i: (k, r) for i, k, r in whole}
    assert kinds[2] == ("response", None) and kinds[5] == ("revisit", 2) and kinds[9] == ("revisit", 2)
    assert kinds[1] == kinds[3] == kinds[4] == kinds[6] == ("response", None)
    assert kinds[7] == ("response", None) and kinds[8] == ("revisit", 7) and kinds[10] == ("response", None) and kinds[None] == ("revisit", 10)
    assert sum(c.is_last for c in chunks) == len(rows)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.rglob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nX: y" not in data


def test_changed_archives_are_an_error_and_empty_tables_are_fine(spark, tmp_path):
    from pit_engine.llm.warc import plan_records, read_archives, write_archives

    _, df = pages(spark)
    manifest = write_archives(plan_records(df.coalesce(1)), f"file://{tmp_path}/w")
    path = next(tmp_path.rglob("*.warc.gz"))
    data = bytearray(gzip.decompress(path.read_bytes()))
    data[data.index(b"xxxx") + 1] = ord("q")
    path.write_bytes(gzip.compress(bytes(data)))
    with pytest.raises(Exception, match="digest"):
        read_archives(manifest).collect()
    assert read_archives(write_archives(plan_records(df.limit(0)), f"file://{tmp_path}/e")).count() == 0


# ------------------------------------------------------------------ conversations


def fold_by_hand(events):
    """The same fold as a plain loop over the sorted log."""
    out = {}
    rank = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3}
    for conv in {e[0] for e in events}:
        slots, roles = {}, {}
        for _, seq, slot, op, role, text in sorted((e for e in events if e[0] == conv), key=lambda e: (e[1], rank[e[3]], e[5] or "")):
            if op in ("message", "edit"):
                slots[slot] = text or ""
                if op == "message":
                    roles[slot] = role
            elif op == "regenerate":
                slots = {k: v for k, v in slots.items() if k < slot} | {slot: ""}
            else:
                slots[slot] = slots.get(slot, "") + (text or "")
        out[conv] = [(roles.get(k) or "", v) for k, v in sorted(slots.items())]
    return out


EVENTS = [
    (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "he"), (1, 4, 2, "delta", None, "llo"), (1, 5, 3, "message", "user", "more"),
    (1, 6, 4, "message", "assistant", "old"), (1, 7, 2, "regenerate", None, None), (1, 8, 2, "delta", None, "new "), (1, 9, 2, "delta", None, "answer"), (1, 10, 3, "message", "user", "again"), (1, 11, 1, "edit", None, "hi!"),
    (2, 5, 1, "message", "user", None), (2, 6, 1, "delta", None, None), (2, 6, 1, "delta", None, "b"), (2, 6, 1, "delta", None, "a"), (3, 1, 1, "regenerate", None, None), (None, 1, 1, "message", None, "x"),
]


def test_fold_equals_a_loop(spark):
    from pit_engine.llm.chat import fold

    log = spark.createDataFrame(EVENTS, "conv_id bigint, seq bigint, slot bigint, op string, role string, text string").repartition(4)
    got = {}
    for r in sorted(fold(log).collect(), key=lambda r: r.slot):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == fold_by_hand(EVENTS)
    assert fold(log.limit(0)).count() == 0


def test_rendering_is_reversible(spark):
    from pit_engine.llm.chat import fold, read_back, render, row_events

    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<|turn|>x\n<|text|>y\n<|end|>\n", "a\\", "", None, "<<SYS>> \\<s> [/INST]\\[INST]", "\\" * 3000, "日本 😀 <s>"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(odd)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "<|text|>", "z"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("slot", F.lit("clash"))
    got = {r.conv_id: r for r in read_back(render(fold(row_events(df)))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(("user", "assistant")[k % 2], t or "") for k, t in enumerate(odd)]
    assert got[1].learned == "".join(t or "" for k, t in enumerate(odd) if k % 2)
    assert [(t.role, t.text) for t in got[2].turns] == [("<|text|>", "z"), ("assistant", "x"), ("assistant", "x")]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert got[1].formatted.count("<|turn|>") == len(odd) + 1  # one of them escaped
    assert read_back(render(fold(row_events(df.limit(0))))).count() == 0


# ------------------------------------------------------------------ exact search


def brute(vectors, ids, is_query, k):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in zip(ids, vectors, strict=True) if j != i and len(w) == len(v))
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def test_threshold_search_equals_brute_force():
    from pit_engine.llm.topk import threshold_search

    rng = np.random.default_rng(0)
    for n, d in ((1, 3), (5, 4), (300, 8), (257, 1)):
        x = rng.integers(-5, 6, (n, d))
        x[: n // 3] = x[0]
        ids = rng.permutation(n)
        want = brute(x.tolist(), ids.tolist(), lambda i: True, 5)
        got = {}
        for q, i, s in threshold_search(x, ids, x, ids, 5):
            got.setdefault(q, []).append((i, s))
        assert got == {q: w for q, w in want.items() if w}


def test_top_k_over_blocks(spark):
    from pit_engine.llm.topk import integer_vectors, top_k

    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 330)]
    bad = [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (501, [float("inf")] * 6), (550, []), (None, rows[0][1]), (600, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("clash"))
    got = {}
    for r in top_k(integer_vectors(df), F.col("vec_id") % 50 == 0, block=64, query_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [[int(np.floor(256 * x)) for x in v] for _, v in rows]
    assert got == brute(whole, [i for i, _ in rows], lambda i: i % 50 == 0, 5)
    assert top_k(integer_vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_own_rows_with_repeated_ids_are_left_out(spark):
    from pit_engine.llm.topk import integer_vectors, top_k

    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [3.0]), (2, [3.0])], "vec_id bigint, embedding array<float>")
    got = top_k(integer_vectors(df), F.col("vec_id") == 1).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 768 * 768), (0, 512 * 768), (0, 256 * 768)]


def test_repeated_queries_and_large_components(spark):
    from pit_engine.llm.topk import integer_vectors, top_k

    big = 3e38
    rows = [(0, [big, 1.0]), (0, [big, 1.0]), (1, [big, 2.0]), (2, [-big, 0.0]), (3, [0.0, 5.0]), (4, [1e9, 1e9]), (5, [0.25, 0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(integer_vectors(df), F.col("vec_id") % 4 == 0, k=3).collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [(1, 2**63 - 1), (4, 2**63 - 1), (5, 2**63 - 1)]
    assert [got[4, k] for k in (1, 2, 3)] == [(0, 2**63 - 1), (0, 2**63 - 1), (1, 2**63 - 1)]
    assert len(got) == 6
    whole = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1.0, 0.5]), (2, [-1.0, -0.25])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(integer_vectors(whole), F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 256 * 10**9 * (256 + 128)), (2, 256 * 10**9 * (-256 - 64))]


def test_archives_with_very_long_urls(spark):
    from pit_engine.llm.warc import plan_records, read_archives, write_archives

    url = "http://example.org/" + "a" * 3_000_000
    pages = spark.createDataFrame([(1, url, "x" * 200), (2, url, "x" * 200)], "page_id bigint, url string, html string")
    got = {r.record_id: r for r in read_archives(write_archives(plan_records(pages))).where("is_last").collect()}
    assert got[1].target_uri == url and got[2].refers_to == 1 and got[2].record_type == "revisit"


# ------------------------------------------------------------------ the registered queries


def test_queries_with_sql_equal_it(spark):
    import os

    import duckdb

    from pit_engine.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        got = sorted(map(tuple, df.select(*columns).collect()), key=str)
        assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str), name
