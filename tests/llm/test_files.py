"""WARC archives, token files and the pipeline: exact round trips."""

import gzip
import hashlib
import io
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odd import ODD
from strandloom.llm import decontaminate, mixing, queries, simhash, token_codes, toxicity, warc
from test_text_ops import brute_tiles

# --- WARC ---

PAGES = [(1, "http://a/%0A\n", "p" * 200), (2, None, "p" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "p" * 200), (1, "u", "p" * 200),
         (7, "u", "ümläut\r\n\r\n" * 20_000)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("first", F.lit("clash"))


def test_round_trip(spark):
    got = sorted(map(tuple, warc.round_trip(pages(spark, PAGES)).collect()), key=repr)
    def want(i, html):
        data = (html or "").encode()
        again = len(data) >= 100 and data == b"p" * 200 and i != 1
        return i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None
    assert got == sorted((want(i, h) for i, _, h in PAGES), key=repr)
    assert warc.round_trip(pages(spark, PAGES).where("false")).count() == 0


def test_filters_are_pushed_and_payloads_skipped(spark):
    folder = warc.archive(pages(spark, PAGES))
    df = warc.read_archive(spark, folder)
    rows = {r.page_id: r for r in df.where("record_type = 'response' and page_id >= 3").collect()}
    assert set(rows) == {3, 4, 5, 6, 7} and bytes(rows[7].payload).decode() == "ümläut\r\n\r\n" * 20_000
    assert df.where("page_id = 1 and url like 'http%'").first().url == "http://a/%0A\n"
    assert warc.read_archive(spark, folder, payload=False).where("payload is not null").count() == 0
    reader = warc.WarcReader(folder, True)
    from pyspark.sql.datasource import EqualTo, StringContains

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("url",), "a")])) == [StringContains(("url",), "a")]
    assert all(not reader._wanted({**dict.fromkeys(warc._HEADERS), "record_type": t}) for t in ("response", None))


def test_damage_is_found():
    member = bytearray(warc.gzip_member(warc.make_record({"page_id": 1, "url": "u", "record_type": "response", "payload_bytes": 3, "payload_digest": "x", "refers_to": None, "payload": b"abc"})))
    assert next(warc.records(io.BytesIO(member), lambda r: True, True))["payload"] == b"abc"
    member[-8] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(warc.records(io.BytesIO(member), lambda r: True, True))
    for cut in (b"", member[:-20], b"no archive at all\r\n\r\n"):
        if cut:
            with pytest.raises(ValueError, match="damaged"):
                list(warc.records(io.BytesIO(cut), lambda r: True, True))
        else:
            assert list(warc.records(io.BytesIO(cut), lambda r: True, True)) == []


def foreign(kind, url, block, extra=""):
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:uuid:{url}>\r\nWARC-Target-URI: {url}\r\n{extra}Content-Length:{len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


FOREIGN = [foreign("warcinfo", "about%0A", b"software: other\r\n"), foreign("request", "http://a/", b"GET / HTTP/1.1\r\n\r\n"),
           foreign("response", "http://a/", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>one</p>\r\n\r\ntwo", "WARC-Payload-Digest: sha1:ABC\r\n"),
           foreign("response", "http://b/", b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 3000), foreign("revisit", "http://c/", b"HTTP/1.1 200 OK\r\n\r\n"), foreign("resource", "http://d/", b"")]


def test_foreign_archives(spark, tmp_path):
    layouts = {"plain.warc": b"".join(FOREIGN), "members.warc.gz": b"".join(gzip.compress(r) for r in FOREIGN), "whole.warc.gz": gzip.compress(b"".join(FOREIGN)),
               "pairs.warc.gz": b"".join(gzip.compress(a + b) for a, b in zip(FOREIGN[::2], FOREIGN[1::2])) + b"\0" * 20}
    for name, data in layouts.items():
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no archive")
    df = warc.read_archive(spark, f"file://{tmp_path}")
    rows = df.collect()
    assert len(rows) == len(FOREIGN) * len(layouts) and df.rdd.getNumPartitions() == len(layouts)
    for r in rows:
        if r.url == "http://a/" and r.record_type == "response":
            assert bytes(r.payload) == b"<p>one</p>\r\n\r\ntwo" and r.payload_bytes == 17 and r.payload_digest == "sha1:ABC" and r.page_id is None
        if r.url == "http://b/":
            assert bytes(r.payload) == bytes(range(256)) * 3000
    assert {r.record_type for r in rows} == {"warcinfo", "request", "response", "revisit", "resource"} and any(r.url == "about%0A" for r in rows)
    assert df.where("record_type = 'response' and payload_bytes > 1000").count() == len(layouts)
    assert warc.read_archive(spark, f"file://{tmp_path}/sub/plain.warc", payload=False).where("record_type = 'response'").count() == 2
    with pytest.raises(Exception, match="no WARC archives"):
        warc.read_archive(spark, f"file://{tmp_path}/nowhere").count()


def test_unwanted_payloads_are_not_inflated():
    big = warc.gzip_member(warc.make_record({"page_id": 1, "url": "u", "record_type": "response", "payload_bytes": 9, "payload_digest": "x", "refers_to": None, "payload": bytes(10_000_000)}))
    broken = bytearray(big)
    broken[-40:-8] = b"x" * 32  # only a reader that inflates the payload can find this
    small = warc.gzip_member(warc.make_record({"page_id": 2, "url": "u", "record_type": "response", "payload_bytes": 3, "payload_digest": "y", "refers_to": None, "payload": b"abc"}))
    assert [r["page_id"] for r in warc.records(io.BytesIO(bytes(broken) + small), lambda r: r["page_id"] == 2, True)] == [2]
    assert [r["payload"] for r in warc.records(io.BytesIO(bytes(broken) + small), lambda r: True, False)] == [None, None]


def test_revisits_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    more = [(100 + i, "u", f"page {i % 7} " * 30) for i in range(40)]
    got = sorted(map(tuple, warc.round_trip(pages(spark, PAGES + more)).collect()), key=repr)
    monkeypatch.undo()
    assert got == sorted(map(tuple, warc.round_trip(pages(spark, PAGES + more)).collect()), key=repr)


# --- tokens ---

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_codes.TOKENIZER))


@pytest.mark.parametrize("n, most", [(0, 1), (1, 300), (5000, 200), (5000, 70_000), (2000, 2**32)])
def test_codes(n, most):
    v = np.random.default_rng(1).integers(0, most, n)
    d = token_codes.DacArray.encode(v)
    assert (d.decode() == v).all() and all(d[i] == v[i] for i in range(0, n, 7))
    with pytest.raises(IndexError):
        d[n]


def test_word_encoder_equals_the_library(tokenizer, monkeypatch):
    import random

    import public_tokenizers

    rng = random.Random(2)
    enc = token_codes.WordEncoder(public_tokenizers.path(token_codes.TOKENIZER))
    alphabet = "aAbBéÉßΣσςİıdon't.,!?  \n\t\xa0\x85\x1c19٣́éﬁ’'S ll'VE中文한ᄒ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))) for _ in range(3000)] + ["a<|endoftext|>b", "Hello, World. " * 500]
    for limit in (token_codes.MEMO_WORDS, 50):
        monkeypatch.setattr(token_codes, "MEMO_WORDS", limit)
        for t, raw in zip(texts, enc.encode(texts)):
            assert raw == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_token_table(docs, tokenizer, spark):
    rows = ODD + [(i, f"text number {i} of many") for i in range(100, 160)]
    got = token_codes.token_table(docs(rows), file_tokens=50).collect()
    assert len(got) == len(rows)
    start = 0
    texts = {i: t for i, t in rows}
    for r in sorted(got, key=lambda r: (r.start)):
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_codes.token_table(docs([])).count() == 0


def test_random_access(docs, tokenizer, spark):
    from strandloom.llm.common import new_folder, open_fs

    folder = new_folder(spark, "tokens")
    manifest = token_codes.write_tokens(docs([(1, "one two three"), (2, "four")]), folder=folder).orderBy("base").collect()
    fs, _ = open_fs(folder)
    seen = []
    for m in manifest:
        f = token_codes.TokenFile(fs.open_input_stream(m.path).read())
        for d in range(len(f.doc_ids)):
            seen += [f.token(d, i) for i in range(int(f.starts[d + 1] - f.starts[d]))]
    want = [*tokenizer.encode("one two three", add_special_tokens=False).ids, 2, *tokenizer.encode("four", add_special_tokens=False).ids, 2]
    assert seen == want


def test_codes_of_token_ids_take_no_wider_copy():
    import tracemalloc

    v = np.random.default_rng(1).integers(0, 49_000, 1_000_000).astype("<u4")
    tracemalloc.start()
    d = token_codes.DacArray.encode(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (d.decode() == v).all() and peak < 3.5 * v.nbytes


# --- memory of workers ---

def test_a_worker_holds_the_data_of_one_operator(spark, docs, monkeypatch):
    import weakref

    import pyarrow as pa

    d = docs([(1, "grumbolt tiso bara"), (2, "bara bara")])
    bench = spark.createDataFrame([(1, "bara tiso")], "item_id long, text string")
    tasks = []
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, run, schema, *a, **k: tasks.append(run) or spark.createDataFrame([], schema))
    simhash.fingerprints(d)
    decontaminate.contaminations(d, bench)
    toxicity.score(d, toxicity.Model(toxicity.CharModel("unread"), {}, 0.0))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": ["bara bara"]})
    assert len(tasks) == 3
    for run in tasks:
        encoder = weakref.ref(token_codes._encoder(None))
        assert token_codes._encoder(None) is encoder()  # one for all tasks of its own operator
        assert sum(b.num_rows for b in run(iter([batch]))) <= 1
        assert encoder() is None


def test_words_remembered_for_decontamination_are_bounded():
    memo = decontaminate._Memo({"known": 0})
    assert all(memo[f"word{i},"] == -1 for i in range(300_000))
    assert len(memo) <= 200_000 and (memo["known."], memo["--"]) == (0, -2)


# --- pipeline and registered queries ---

def near_copies(rows):
    """Ids that go: not the least of their group under links of similarity 0.8 of five-word shingles, by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) != i}


def leaked(rows, items):
    """Ids of texts half of a test item's words of which can be tiled by runs of five words and more, longest first."""
    edge = string.punctuation + "«»“”„‘’‚…–—¡¿"
    norm = lambda t: [w for w in (x.strip(edge) for x in (t or "").lower().split()) if w]
    out = set()
    for i, t in rows:
        w = norm(t)
        grams = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        for _, text in items:
            item = norm(text)
            own = {tuple(item[k:k + 5]) for k in range(len(item) - 4)}
            if not own & grams:
                continue
            seq = []
            marks = set()
            for k in range(len(w) - 4):
                if tuple(w[k:k + 5]) in own:
                    marks |= set(range(k, k + 5))
            for k, word in enumerate(w):
                if k in marks:
                    seq.append(word)
                elif seq and seq[-1] is not None:
                    seq.append(None)
            if sum(n for _, _, n in brute_tiles(item, [x if x is not None else object() for x in seq], 5)) >= 0.5 * len(item):
                out.add(i)
    return out


def unmixed(rows_df):
    """Ids that the mixture's SQL leaves out, on the rows given."""
    import duckdb

    con = duckdb.connect()
    table = rows_df.toArrow()
    con.register("documents", table)
    return {r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.oracle_sql(max_epochs=1)}) WHERE copies = 0").fetchall()}


def test_pipeline(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    cols, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir)
        assert out.columns == cols
        rows = [(r.doc_id, r.text) for r in seen.collect()]
        before, after = {i for i, _ in rows}, {r.doc_id for r in out.collect()}
        assert after <= before
        gone = before - after
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(seen, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.predicted}
        else:
            want = {"simhash near-dedup": lambda: near_copies(rows), "benchmark decontamination": lambda: leaked(rows, items), "mixing": lambda: unmixed(seen)}[name]()
            assert want, name
        assert gone == want, name
        seen = out
    texts = {r.doc_id: r.text for r in seen.collect()}
    start = 0
    got = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == sorted(texts)
    for r in got:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("rows", [ODD, [], [(None, None)], [(1, None), (1, None)]])
def test_pipeline_on_odd_documents(spark, docs, sf_dir, rows):
    seen = docs(rows, extra=False)
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, sf_dir)
    assert seen.count() <= len(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    from support import same_rows

    ours, theirs = same_rows(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_whole_tables(spark, sf_dir, name):
    table = "pages" if name in ("op1_html_main_text", "op6_warc") else "documents"
    n = queries.queries()[name](spark, sf_dir).count()
    assert n == spark.read.parquet(f"{sf_dir}/{table}.parquet").count() or name == "op3_decontamination"
