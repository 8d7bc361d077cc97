"""Operators over small tables with nulls, empty texts, ties, repeated rows, clashing columns; queries against SQL or brute force."""

import hashlib
import itertools
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, common, decontaminate, fim, flac, graph, hnsw, minhash, mixing, pii, queries, suffix_dedup, toxicity, url_filter, warc, whitening

WORDS = "ka lo mi nu pe ra so ti vu wa".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _row int, copies string"


def prose(seed: int, n: int = 80) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(WORDS, 3)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    near = prose(1).split()
    near[40] = "other"
    texts = [prose(1), prose(1), " ".join(near), prose(2), None, "", "  \t", "one two", "one two", "long " * 20000, prose(3) + " mail a@b.org idiot", "x" * 60 + prose(2)]
    out = [(i, t, "en", ["a", None, "b"][i % 3], len(t or ""), "s", 7, "c") for i, t in enumerate(texts)]
    return [*out, out[3], (None, prose(4), "en", "a", 1, "s", 7, "c")]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("d") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).write.parquet(path)
    return spark.read.parquet(path)


def test_near_duplicates(docs, rows):
    got = minhash.near_duplicates(docs, width=3, percent=85).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.component_id, r.kept) for r in got}
    assert by[0] == (0, True) and by[1] == (0, False) and by[2] == (0, False)
    assert by[7] == (7, True) and by[8] == (7, False)
    assert by[None] == (None, False) and all(by[i] == (i, True) for i in (3, 4, 5, 6, 9, 10))
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_suffix_removal(docs, rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.kept) for r in suffix_dedup.without_repeats(docs).collect())
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        earlier = {u[k : k + 50] for j, x, *_ in rows for u in [(x or "").encode()] if j is not None and (i is None or j < i) for k in range(len(u) - 49)}
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if b[k : k + 50] in earlier:
                gone[k : k + 50] = True
        want.append((i is None, i or 0, len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    assert got == sorted(want)
    assert suffix_dedup.without_repeats(docs.where("false")).count() == 0


def test_media(docs, rows):
    out = {(r.doc_id, r.n_bytes): r for r in flac.described(flac.media(docs)).collect()}
    for i, t, *_ in rows:
        n, payload = flac.padded(t)
        r = out[(i, n)]
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.payload_bytes == len(payload)
    blocks = flac.pcm_blocks(flac.media(docs)).where("doc_id = 9").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0") == ("long " * 20000).encode()
    assert flac.described(flac.media(docs.where("false"))).count() == 0


def test_bpe(docs, rows):
    out = bpe.decode(bpe.encode(docs))
    assert out.columns == [*(c for c in docs.columns if c != "text"), "n_tokens", "ids", "decoded"]
    out = out.collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((t or "").encode() for _, t, *_ in rows) and all(len(r.ids) == 4 * r.n_tokens for r in out)
    again = bpe.encode(docs.withColumnRenamed("copies", "ids")).columns
    assert again == [*(c for c in docs.columns if c not in ("text", "copies")), "n_tokens", "ids"]
    assert bpe.decode(bpe.encode(docs.where("false"))).count() == 0


def test_bpe_in_slices(docs, monkeypatch):
    """Blocks dealt into slices, each with its own buckets, have the ids that one slice gives."""
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids) for r in df.collect())
    whole = key(bpe.encode(docs))
    monkeypatch.setattr(bpe, "SLICE_TEXT", 20_000)
    dealt = bpe.numbered(docs.repartition(6).select("text", F.struct("doc_id").alias("_row")), bpe.public_tokenizers.PATTERN, 8, 6).where("_bucket is not null")
    of_block = dealt.groupBy("_block").agg(F.min(F.floor(F.col("_bucket") / 8)).alias("a"), F.max(F.floor(F.col("_bucket") / 8)).alias("b")).collect()
    assert all(r.a == r.b for r in of_block) and len({r.a for r in of_block}) > 1
    assert key(bpe.encode(docs.repartition(6))) == whole


def test_long_runs_take_linear_time(docs):
    tagger = pii.Tagger(pii.train())
    began = time.process_time()
    for t in ("7" * 10**6, "1." * 300_000, "1-" * 300_000, "a@" * 300_000, ".".join(["9" * 1000] * 600)):
        pii.all_spans([t], tagger)
    assert time.process_time() - began < 20
    assert [pii.plain_spans(f"x{a}1.2.3.4{b}") for a, b in (("", ""), ("9.", ""), ("", ".5"), ("300.", ""))] == [[(1, 1, 8)], [(1, 1, 8)], [(1, 1, 8)], []]
    assert "text" not in pii.find(docs, texts=False).columns and {r.spans for r in pii.find(docs, texts=False).collect()} == {r.spans for r in pii.find(docs).collect()}


def test_personal_data(docs, rows):
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    assert out[10].n_email == 1 and "<EMAIL>" in out[10].redacted and out[4].redacted is None and out[4].spans == ""
    assert pii.find(docs.where("false")).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, None), (3, 0, 0), (10, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(docs, none).count() == docs.count() and toxicity.score(docs.where("false"), none).count() == 0


def test_mixing(docs, rows):
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(docs.where("false")).count() == 0


def test_mix_takes_repeats_apart(spark, tmp_path):
    same = [(7, " ".join(["same"] * 10), "a")] * 100
    rows = [*same, *((100 + i, prose(i, 1 + 7 * i), "b") for i in range(30)), *((200 + i, prose(i, 20), None) for i in range(9)), *((300 + i, t, "b") for i, t in enumerate((None, "", " ")))]
    rows += [(300, None, "b"), (None, prose(99), "c"), (None, prose(99), "c"), (400, "w " * 2000, "d"), *same[:7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("x"))
    df.repartition(5, "source", "copies", F.rand(1)).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op3_mixing"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, queries.QUERIES["op3_mixing"](spark, str(tmp_path)).collect()))
    size = {(d, s): len((t or "").split()) for d, t, s in rows}
    by = {}
    for (_, _, s), r in zip(sorted(rows, key=lambda r: str(r[0])), sorted(out, key=lambda r: str(r.doc_id)), strict=True):
        assert r["size"] == size[r.doc_id, s] and r.taken <= 3 * r["size"]
        by.setdefault(s, [r.source_size, r.target, 0, 0])[2] += r.taken
        by[s][3] = max(by[s][3], r["size"])
    assert all(abs(taken - target) <= largest / 2 + 1e-6 for _, target, taken, largest in by.values())
    assert abs(sum(t for _, t, _, _ in by.values()) - sum(n for n, *_ in by.values())) < 1e-6 and all(t <= 3 * n + 1e-9 for n, t, _, _ in by.values())
    assert {r.taken // 10 for r in out if r.doc_id == 7} == {by["a"][1] // 1070, by["a"][1] // 1070 + 1}
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert mixed.columns == df.columns and mixed.where("doc_id = 7").count() * 10 == by["a"][2]
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.OP3_SQL).df()
    assert sorted(zip(want.doc_id.fillna(-1), want.taken, want.target.round(6), strict=True)) == sorted((-1 if r.doc_id is None else r.doc_id, r.taken, round(r.target, 6)) for r in out)


def test_url_rules(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/12#a"), (3, "http://example.org/en/2"), (4, None), (5, "no scheme"), (6, "http://notexample.org/es/"), (7, "http://x.com/de/1"), (8, "http://com/fr/"), (9, "http://x.net/"), (9, "http://x.net/"), (10, "http://org")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    out = [(r.page_id, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rule_table(spark)).orderBy("page_id").collect()]
    assert out == [(1, "example.org/es/", "block"), (2, "example.org/en/1", "block"), (3, "org/", "allow"), (4, None, "allow"), (5, None, "allow"), (6, "org/", "allow"), (7, "com/de/", "block"), (8, "com/fr/", "allow"), (9, None, "allow"), (9, None, "allow"), (10, None, "allow")]
    assert url_filter.judge(df.where("false"), url_filter.rule_table(spark)).count() == 0
    assert url_filter.judge(df, url_filter.rule_table(spark).where("false")).count() == len(rows)


REDIRECTS = [
    "https://example.org#http://x/es/1", "http://x.com?next=https://y.com/de/1", "http://x.com/fr/a://b/de/1?u=http://example.org/es/1", "http://a.com/de/1#http://", "://example.org/es/2",
    "https://example.org/?u=https://example.org/es/", "http:///es/1", "HTTP://EXAMPLE.ORG/ES/", "http://example.org/es/" + "long/" * 20000, "", "://", "a://b://c/de/", "http://x.com\n/de/1", None, "http://x.com/de", "http://.com/de/",
]


@pytest.mark.parametrize("broadcast", [50, 0])
def test_redirects_match_sql(spark, tmp_path, broadcast):
    duckdb = pytest.importorskip("duckdb")
    df = spark.createDataFrame([*enumerate(REDIRECTS), *((100 + i, REDIRECTS[2]) for i in range(300))], "page_id long, url string").withColumn("site", F.lit(1)).withColumn("n", F.lit(2))
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    found = url_filter.judge(df, url_filter.rule_table(spark), broadcast_rules=broadcast)
    assert found.columns == ["page_id", "url", "site", "n", "host", "path", "rule", "verdict"]
    out = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect())
    assert out == sorted(con.execute(url_filter.OP4_SQL).fetchall())
    assert out[0][1:] == ("example.org", "", None, "allow") and out[1][1:] == ("x.com", "", None, "allow") and out[8][3] == "example.org/es/"


def test_many_shapes_are_one_expression(spark):
    rules = [("x.org", "/" + "a" * n, "block" if n % 2 else "allow") for n in range(400)] + [("x.org", "/aa", "block"), ("y.x.org", "/a", "allow"), (None, "/", "block"), ("z.org", "/", None)]
    urls = ["http://y.x.org/" + "a" * n for n in (0, 1, 2, 3, 399, 5000)] + ["http://z.org/"]
    found = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark, rules))
    out = {r.page_id: (r.rule, r.verdict) for r in found.collect()}
    assert out == {0: ("x.org/", "allow"), 1: ("y.x.org/a", "allow"), 2: ("y.x.org/a", "allow"), 3: ("y.x.org/a", "allow"), 4: ("x.org/" + "a" * 399, "block"), 5: ("x.org/" + "a" * 399, "block"), 6: ("z.org/", "allow")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") < 20


def test_archives(spark):
    long = "<p>ä</p>" * 200
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, "short"), (4, "http://c", "short"), (5, "http://d", None), (None, "http://e", long), (2, "http://b", long)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    out = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(warc.classified(df))).collect()), key=str)
    n = len(long.encode())
    assert out == sorted([(1, "revisit", 2, n), (2, "response", None, n), (2, "response", None, n), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (0, "revisit", 2, n)], key=str)
    assert warc.read_archives(warc.write_archives(warc.classified(df.where("false")))).count() == 0


def test_vectors(spark):
    a = [1.0, 0.0, 0.0]
    rows = [(1, a, 0), (2, [2.0, 0.0, 0.0], 0), (3, a, 1), (4, a, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 0.0], 0), (8, [float("nan"), 0.0, 0.0], 0), (9, [0.0, 1.0, 0.0], 0), (10, a, 0), (10, a, 0), (None, a, 0), (11, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, links int")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df).collect()}
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[10] == (2, 1, False)
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)) and out[None] == (0, None, False)
    assert hnsw.near_vectors(df.where("false")).count() == 0


def test_repeated_ids_tie_their_texts(spark):
    a, b = prose(11), prose(12)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, prose(13)), (4, prose(13))]
    out = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("shard", [100, 16384])
def test_vectors_match_brute_force(spark, shard):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(220, 12))
    x = np.concatenate((centre, centre[:80] + 0.08 * rng.normal(size=(80, 12)), centre[:1] + 0.02 * rng.normal(size=(100, 12)), centre[:5]))
    label = np.append(np.zeros(220, int), np.zeros(185, int))
    df = spark.createDataFrame([(i, [float(v) for v in row], int(k)) for i, (row, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    near = hnsw.unit(x) @ hnsw.unit(x).T >= 0.93
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
    out = {r.vec_id: r for r in hnsw.near_vectors(df, shard=shard).collect()}
    links = sum(r.n_links for r in out.values())
    assert 0.98 * near.sum() <= links <= near.sum() and out[0].recall >= 0.98
    assert sum(out[i].component_id != root[i] for i in out) <= 0.02 * len(x) and out[0].n_links >= 100


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts():
    if not DATA.exists():
        pytest.skip("the tables aren't here")
    import pyarrow.parquet as pq

    t = pq.read_table(DATA / "documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def rows_of(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, str(DATA)).collect()}


def test_op1_matches_all_pairs(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = graph.forest(*zip(*edges, strict=True)) if edges else {}
    out = rows_of(spark, "op1_minhash")
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == {i: (len(s), roots.get(i, i)) for i, s in sets.items()}


def test_op6_matches_patterns(spark, texts):
    def luhn(d):
        return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0

    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    )
    out = rows_of(spark, "op6_pii")
    seen = 0
    for i, t in texts.items():
        found = [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        r, seen = out[i], seen + len(found)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for n, _, _ in found) for k, _, _ in kinds]
        assert set(base.split(",")) <= set(r.spans.split(","))
    assert seen > 10


def test_op7_op8_op9_match_brute_force(spark, texts):
    import public_tokenizers as P
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    media, cut, coded = (rows_of(spark, n) for n in ("op7_flac", "op8_suffix_array", "op9_bpe"))
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        payload = b + bytes(-len(b) % 64 or (64 if not b else 0))
        assert (media[i].n_bytes, media[i].payload_sha256, media[i].tail_crc32) == (len(b), sha(payload), zlib.crc32(payload[-64:]))
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (cut[i].n_removed, cut[i].n_spans, cut[i].kept_sha256) == (int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
        ids = np.array(reference.encode_ordinary(texts[i] or ""), "<u4")
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(b))


def test_op5_learns_planted_words(spark, tmp_path):
    rows = [(i, prose(1000 + i, 30) + (" you zorbul fool. " if i % 6 == 0 else " ") + prose(5000 + i, 30)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = [r for r in queries.QUERIES["op5_toxicity"](spark, str(tmp_path)).collect() if r.held_out]
    toxic, clean = ([r.score for r in out if (r.doc_id % 6 == 0) is k] for k in (True, False))
    assert len(out) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(900))
    assert np.mean([t > c for t in toxic for c in clean]) > 0.98 and np.mean([t >= 0.3 for t in toxic]) > 0.95 and np.mean([c >= 0.3 for c in clean]) < 0.05


def test_pipeline_on_empty_tables(spark, docs, tmp_path):
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_tables_go(spark):
    scratch = common.Scratch(spark)
    scratch.write(spark.range(3), "t")
    assert Path(scratch.root.removeprefix("file://")).exists()
    common.release()
    assert not Path(scratch.root.removeprefix("file://")).exists() and not common.Scratch.open


def test_hot_keys_are_split(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(k, k) for k in range(2, 400)] + [(None, 5)], "k long, by long")
    sizes = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("twice", F.col("k") * 2)
    out = common.split_join(rows, sizes, "k", "by", 3399)
    assert out.columns == ["k", "by", "twice"] and sorted((r.k, r.by, r.twice) for r in out.collect()) == sorted((k, b, 2 * k) for k, b in [(1, i) for i in range(3000)] + [(k, k) for k in range(2, 400)])
    assert common.split_join(rows, sizes.where("false"), "k", "by", 3399, "left").count() == 3399


def test_pipeline_keeps_columns(spark, docs, tmp_path):
    spark.createDataFrame([(0, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert now.where(F.col("doc_id") == 1).count() == 0 and now.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("the tables aren't here")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    found = queries.QUERIES[name](spark, str(data)).toPandas()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].round(5).astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(want.columns) == sorted(found.columns) and key(want) == key(found)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("character", r"(?s).")])
def test_cuts_fall_between_units(unit, pattern, chunk):
    rng = np.random.default_rng(chunk)
    texts = ["".join(rng.choice(list("ab\nä €\n"), rng.integers(40))) for _ in range(150)] + ["", "a<S>b\nc", "\n" * 9000, "é" * 9001]
    ids = [None, *range(1, len(texts))]
    for t, i, (n, form, out, p, m) in zip(texts, ids, fim.transformed([t.encode() for t in texts], ids, unit=unit, chunk=chunk), strict=True):
        u = re.findall(pattern, t)
        h = fim.draws(i, 7)
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        start, middle, end = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        want = f"<S>{end}<P>{start}<M>{middle}" if h[3] % 100 < 50 else f"<P>{start}<S>{end}<M>{middle}"
        plain = not t or "<S>" in t
        assert (n, form == "plain", out.decode()) == (len(u), plain, t if plain else want)
        assert (p, m) == ((None, None) if plain else (len(start), len(middle))) and fim.restored(out, form) == t.encode()


def test_fill_in_middle(docs, rows):
    made = fim.fill_in_middle(docs.withColumnRenamed("score", "form"), percent=60)
    assert made.columns == [c for c in docs.columns if c != "score"] + ["n", "form", "output", "prefix_chars", "middle_chars"]
    out = fim.restore(made).collect()
    assert sorted(r.restored for r in out) == sorted(t or "" for _, t, *_ in rows) and {r.form for r in out} == {"plain", "psm", "spm"}
    words = fim.restore(fim.fill_in_middle(docs, unit="word")).collect()
    assert {(r.doc_id, r.n, r.restored) for r in words} == {(i, len(re.findall(r"\S+\s*|^\s+(?=\S)", t or "")) or int(bool(t)), t or "") for i, t, *_ in rows}
    assert fim.restore(fim.fill_in_middle(docs.where("false"))).count() == 0 == fim.digests(docs.where("false")).count()


BENCH = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short ITEM"), (2, "short item"), (3, None), (4, "... !"),
    (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "null's own"), (10, "Ünï cödé 漢字"),
]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_decontamination(spark, limit):
    inside = "x " * 5 + "ALPHA, beta-gamma delta (epsilon) zeta eta theta iota kappa lambda mu nu"
    texts = [inside, inside, "beta gamma delta epsilon zeta eta theta iota kappa", "a short\nitem b short itemx", None, "", "?", "null s own Ünï cödé 漢字 ünï cödé 漢字", "w" * 5000 + " short item " + "w" * 70000, "Short item " * 30000]
    docs = spark.createDataFrame([*enumerate(texts), (None, inside)], "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("_key", F.lit("k"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("text_", F.lit(1))

    def words(t):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return [(m.start(), m.end(), m[0]) for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)]

    out = sorted(decontaminate.scan(docs, bench, limit=limit).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    for t, r in zip([*texts, inside], out, strict=True):
        w, hit, names = words(t), set(), set()
        for item, b in BENCH:
            bw = [x for *_, x in words(b)]
            k = min(10, len(bw))
            grams = {tuple(bw[i : i + k]) for i in range(len(bw) - k + 1)} if k else set()
            at = [i for i in range(len(w) - k + 1) if tuple(x for *_, x in w[i : i + k]) in grams] if k else []
            hit |= {j for i in at for j in range(i, i + k)}
            names |= {"null" if item is None else str(item)} if at else set()
        assert (r.n_words, r.n_hit, r["items"], r._key) == (len(w), len(hit), sorted(names), "k")
        gone = {p for a, b in zip(r.spans[::2], r.spans[1::2], strict=True) for p in range(a, b)}
        assert {p for j in hit for p in range(w[j][0], w[j][1])} <= gone and len(gone) == sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True))
        assert r.cleaned == (None if t is None else "".join(c for p, c in enumerate(t) if p not in gone))
    assert out[0].n_hit == 12 and out[0].cleaned == "x " * 5 + " nu" and out[3].n_hit == 2 and out[7]["items"] == ["10", "null"]
    left = decontaminate.decontaminate(docs, bench, "documents", limit=limit)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 4, 5, 6}
    spans = decontaminate.decontaminate(docs, bench, limit=limit)
    assert spans.columns == docs.columns and decontaminate.scan(spans, bench).where("n_hit > 0").count() == 0
    for a, b in ((docs, bench.where("false")), (docs.where("false"), bench)):
        assert decontaminate.scan(a, b, limit=limit).where("n_hit > 0").count() == 0


def whitened_by_hand(vectors):
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in vectors}
    once = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(once), once.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(once.T, bias=True).reshape(once.shape[1], -1))
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    return {i: (int(((n * a - sums) ** 2).sum()), (a - sums / n) @ v / np.sqrt(e)) for i, a in x.items()}, n, e, np.cov(once.T, bias=True).trace()


def test_op11_matches_eigenvectors(spark):
    if not DATA.exists():
        pytest.skip("the tables aren't here")
    import pyarrow.parquet as pq

    t = pq.read_table(DATA / "embeddings.parquet").to_pydict()
    want, n, e, trace = whitened_by_hand(zip(t["vec_id"], t["embedding"], strict=True))
    out = queries.QUERIES["op11_whitening"](spark, str(DATA)).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 16 * len(want) and set(out.n) == {n} and out.identity_error.max() < 1e-9 and out.identity_error.nunique() == 1
    got = out.whitened.to_numpy().reshape(-1, 16)
    hand = np.stack([want[i][1] for i in sorted(want)])
    sign = np.sign((got * hand).sum(axis=0))
    assert np.allclose(got * sign, hand, atol=1e-9) and out.deviation.to_list()[::16] == [want[i][0] for i in sorted(want)]
    assert np.allclose(out.explained[:16], e / trace, rtol=1e-9)


def test_whitening_by_the_range_finder(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 40)) * np.r_[2.0 ** -np.arange(8) * 9e4, np.full(32, 0.01)]
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x @ np.linalg.qr(rng.normal(size=(40, 40)))[0])]
    df = whitening.whole(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    quick, full = whitening.fit(df, k=4, oversampling=16, passes=12), whitening.fit(df, k=4, oversampling=0, passes=1)
    assert quick.columns == 20 and quick.passes <= 12 and (full.columns, full.passes) == (40, 2)
    assert np.allclose(np.abs((quick.components * full.components).sum(axis=0)), 1, atol=1e-12) and max(quick.identity_error, full.identity_error) < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [1.5, -1.0]), (3, [1.5, -1.0]), (None, [0.0, 2.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (10, [1e300, 1.0])]
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<double>, n string")
    model = whitening.fit(whitening.whole(df))
    out = whitening.transform(whitening.whole(df), model).collect()
    assert model.n == 3 and sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in out) == sorted((i is None, i or 0, c) for i in (1, 2, 3, 3, None) for c in (1, 2))
    want, n, e, _ = whitened_by_hand([(i, v) for i, v in rows[:5] if i != 2])
    assert {r.vec_id: r.deviation for r in out if r.vec_id in (1, 3)} == {i: want[i][0] for i in (1, 3)} and np.allclose(model.eigenvalues, e)
    one = df.where("vec_id = 1")
    flat = whitening.transform(whitening.whole(one), whitening.fit(whitening.whole(one))).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(c, 1, 0, 0.0, None, 0.0) for c in (1, 2)]
    none = whitening.whole(df.where("false"))
    assert whitening.transform(none, whitening.fit(none)).count() == 0
    big = whitening.Model(1 << 40, [0, 0], np.zeros((2, 0)), np.zeros(0), 0.0, 0.0, 2, 1)
    assert big.deviation(np.array([[1, 1], [1 << 30, 0]])) == [None, None] and big.deviation(np.array([[0, 0]])) == [0]
