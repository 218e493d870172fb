"""Manifest, vector codes and archives against brute force, and on odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from checks.compare import compare
from pluvio.llm import merkle, queries, vector_codes, warc


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The levels of a tree, from its leaves to its one root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[k : k + 2]) for k in range(0, len(now), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1], i % 2 == 1) if i ^ 1 < len(level) else (None, i % 2 == 1))
        i //= 2
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int"


def odd_documents():
    draw = random.Random(4)
    rows = [(i, f"text {i}", draw.choice(["en", "en", "en", "dé", "", None, "z"]), None, draw.choice([None, 3, -2]), "k", 1) for i in range(150)]
    rows += [(7, "text 7", "en", None, 3, "k", 1)] * 3 + [(7, "other", "en", None, 3, "k", 1), (None, "no id", "en", "s", 1, "k", 1), (None, None, None, None, None, None, None)]
    return rows + [(900, "word " * 50000, "en", "", 5, "", 2), (-5, "", "alone", "s", 0, "x", 3)]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest(spark, bits):
    rows = odd_documents()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    leaf = merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    built = merkle.manifest(df, leaf, F.col("doc_id"), F.col("lang"), bits=bits, n=F.col("n_chars"))
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, H(*values), n_chars))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda r: r[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    want = []
    for place, g in enumerate(order):
        for i, (there, doc_id, leaf, n_chars) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            proof = siblings(trees[g], i) + siblings(top, place)
            want.append((doc_id if there else None, leaf, proof, trees[g][-1][0], top[-1][0], n_chars))
    found = [(r.id, r.leaf, [(s.sibling, s.left) for s in r.proof], r.subroot, r.root, r.n) for r in built.proofs().collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    folded = built.proofs().select(merkle.fold(F.col("leaf"), F.col("proof")).alias("f")).distinct().collect()
    assert [r.f for r in folded] == [top[-1][0]]
    # the log of each group lists its nodes in completion order, without gaps
    log = {}
    for r in built.groups.log().collect():
        log.setdefault(r.key, []).append((r.position, r.level, r.idx, r.digest))
    for g in order:
        got = sorted(log["0" if g is None else "1" + g])
        levels = trees[g]
        nodes = [(min((i + 1) << k, len(levels[0])), k, i, d) for k, level in enumerate(levels) for i, d in enumerate(level)]
        assert [r[0] for r in got] == list(range(len(nodes)))
        assert [r[1:] for r in got] == [r[1:] for r in sorted(nodes)]


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    built = merkle.manifest(df, F.sha2("text", 256), F.col("doc_id"), F.col("lang"))
    assert built.root is None and built.proofs().isEmpty() and built.groups.log().isEmpty()


def test_manifest_query_on_odd_documents(spark, tmp_path):
    spark.createDataFrame(odd_documents(), DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duck_with(tmp_path, "documents")
    name = "op11_merkle_manifest"
    assert compare(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLE[name]) is None
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    wrong = {r.doc_id for r in rows if not r.verified}
    assert wrong == {i for i, _, _, _, n, *_ in odd_documents() if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0}


def duck_with(path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con


def codes_by_hand(rows, parts, entries, rounds):
    """Plain product quantisation in integers; ``rows`` are (id, vector)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    v = np.stack([r[1] for r in rows]).reshape(len(rows), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()

    def nearest():
        return np.stack([((v[:, p, None] - books[p]) ** 2).sum(-1).argmin(1) for p in range(parts)], axis=1)

    for _ in range(rounds):
        to = nearest()
        for p in range(parts):
            for e in np.unique(to[:, p]):
                own = v[to[:, p] == e, p]
                books[p, e] = own.sum(0) // len(own)
    to = nearest()
    error = sum(((v[:, p] - books[p][to[:, p]]) ** 2).sum(1) for p in range(parts))
    return [(r[0], bytes(t.tolist()).hex(), int(x)) for r, t, x in zip(rows, to, error)], books


@pytest.mark.parametrize("spread", [0.02, 1.0, 300.0])
def test_vector_codes(spark, spread):
    draw = np.random.default_rng(5)
    centres = draw.normal(0, spread, (9, 12))
    vectors = [(centres[draw.integers(9)] + draw.normal(0, spread / 20, 12)).astype(np.float32) for _ in range(700)]
    vectors += [vectors[0]] * 40 + [np.zeros(12, np.float32)] * 90
    ids = [int(i) for i in draw.permutation(len(vectors))]
    ids[3], ids[4], ids[5] = None, None, ids[6]
    rows = [(i, [float(x) for x in v], k % 3 or None, "x") for k, (i, v) in enumerate(zip(ids, vectors))]
    odd = [
        (5001, None, 1, "x"), (5002, [1.0, None] * 6, 1, "x"), (5003, [float("nan")] * 12, 1, "x"), (5004, [float("inf")] * 12, 1, "x"),
        (5005, [], 1, "x"), (5006, [1.0] * 8, 1, "x"), (5007, [1.0] * 13, 1, "x"), (5008, [1e30] * 12, 1, "x"),
    ]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, error string").repartition(3)
    found = vector_codes.compress(df, parts=4, entries=20, rounds=2, keep=("label",))
    whole = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in zip(ids, vectors)]
    want, books = codes_by_hand(whole, 4, 20, 2)
    got = [(r.row.id, r.code, r.error) for r in found.rows.collect()]
    assert sorted(got, key=repr) == sorted([*want, *[(i, None, None) for i in (5005, 5006, 5007, 5008)]], key=repr)
    assert (found.books == books).all()


def test_blocks_and_leaves_of_any_size():
    draw = np.random.default_rng(2)
    for t in range(150):
        n, d, k = int(draw.integers(1, 400)), int(draw.integers(1, 6)), int(draw.integers(1, 70))
        width = int(draw.choice([1, 4, 100, 1 << 24]))
        points, entries = draw.integers(-width, width + 1, (n, d)), draw.integers(-width, width + 1, (k, d))
        made = vector_codes.Tree(points, vector_codes._depth(n, int(draw.choice([1, 3, 16]))))
        nearest, count, total = vector_codes.assign(made, entries)
        want = ((points[:, None] - entries) ** 2).sum(-1).argmin(1)
        assert (nearest == want[made.order]).all() and (count == np.bincount(want, minlength=k)).all()
        sums = np.zeros_like(entries)
        np.add.at(sums, want, points)
        assert (total == sums).all()


def test_vector_codes_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_codes.compress(spark.createDataFrame([], schema)).rows.isEmpty()
    one = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 16)], schema))
    assert [(r.row.id, r.code, r.error) for r in one.rows.collect()] == [(1, "00" * 16, 0)]


PAGES = "page_id long, url string, html string, path string, content string"


def odd_pages():
    rows = [(i, f"http://x/{i}", f"<p>page {i % 40}</p>" * (1 + i % 5), "p", "c") for i in range(300)]
    rows += [(301, None, "", "p", "c"), (299, "http://x/a b\r\nX: y", None, "p", "c"), (None, "", "<p>é</p>", "p", "c"), (400, "u", "<p>é</p>", None, "c")]
    return rows + [(7, "u", "twice", "p", "c")] * 3 + [(None, "u", "no id", "p", "c")] * 2 + [(500, "u", "long " * 300_000, "p", "c"), (501, "u", "WARC/1.1\r\n\r\n", "p", "c")]


def test_warc_query_on_odd_pages(spark, tmp_path):
    spark.createDataFrame(odd_pages(), PAGES).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duck_with(tmp_path, "pages")
    assert compare(queries.QUERIES["op13_warc"](spark, str(tmp_path)), con, queries.ORACLE["op13_warc"]) is None


def test_warc_round_trip_through_files(spark, tmp_path):
    pages = spark.createDataFrame(odd_pages(), PAGES).repartition(4)
    archives = warc.write(pages, min_bytes=20, archive_bytes=3000)
    assert archives.count() > 8
    assert warc.save(archives, str(tmp_path / "out")).count() == archives.count()
    rows = warc.read(spark.read.format("binaryFile").load(str(tmp_path / "out"))).collect()
    assert not [r for r in rows if r.error]
    assert sum(r.type == "warcinfo" for r in rows) == archives.count()
    own = [r for r in rows if r.type != "warcinfo"]
    stored = {r.record_id: bytes(r.payload) for r in own if r.type == "response"}
    found = []
    for r in own:
        payload = stored[r.headers["warc-refers-to"]] if r.type == "revisit" else bytes(r.payload)
        found.append((int(r.headers["page-id"]) if "page-id" in r.headers else None, payload.decode()))
    assert sorted(found, key=repr) == sorted([(i, h or "") for i, _, h, *_ in odd_pages()], key=repr)
    # small payloads are never revisits, larger ones once a response
    responses = sorted(bytes(r.payload) for r in own if r.type == "response" and len(r.payload) >= 20)
    assert len(responses) == len(set(responses))
    assert all(int(r.http_headers["content-length"]) >= 20 for r in own if r.type == "revisit")
    assert {r.target_uri for r in own if r.target_uri.startswith("http://x/a")} == {"http://x/a%20b%0D%0AX:%20y"}


def test_warc_of_nothing(spark):
    archives = warc.write(spark.createDataFrame([], PAGES))
    assert archives.isEmpty() and warc.read(archives).isEmpty()


def response(payload=b"hello", length=None, **more):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": "u", "Content-Type": "application/http"}
    made = warc.record(fields | more, block)
    return made if length is None else made.replace(f"Content-Length: {len(block)}".encode(), f"Content-Length: {length}".encode())


def archive(*records, dictionary=b"", packed=True):
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
    front = b""
    if dictionary:
        front = warc.leading_frame(dictionary)
        if not packed:
            front = warc.struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary)) + dictionary
    return front + b"".join(packer.compress(r) for r in records)


def test_warc_faults():
    def errors(data):
        return [(r.get("error") or "")[:24] for r in warc.records("a", data)]

    good = response()
    samples = [b"common text of pages %d %d" % (i, i * 7919) * 9 for i in range(400)]
    dictionary = zstandard.train_dictionary(2000, samples).as_bytes()
    for data in (archive(good, good), archive(good, good, dictionary=dictionary), archive(good, good, dictionary=dictionary, packed=False)):
        assert errors(data) == ["", ""]
    # another skippable frame between records, and frames of one run of a byte
    skip = warc.struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert errors(archive(good) + skip + archive(response(b"a" * 400_000))) == ["", ""]
    # a bad record does not hide its neighbours
    bad = [
        response(length=3), response(length="x"), response(**{"WARC-Date": None}), response(**{"WARC-Payload-Digest": "sha1:AAAA"}),
        response(**{"WARC-Block-Digest": "sha1:AAAA"}), good.replace(b"WARC/1.1", b"WARC/9.0"), good[:-2], response(**{"WARC-Target-URI": None}),
        b"", b"WARC/1.1\r\nno field\r\n\r\n\r\n\r\n", response(**{"WARC-Type": "revisit"}), good.replace(b"u\r\n", b"\xff\r\n", 1),
    ]
    for record in bad:
        first, second = errors(archive(record, good))
        assert first and not second
    # a broken frame ends the archive
    whole = archive(good, good)
    half = len(archive(good))
    assert errors(whole[:-1])[0] == "" and errors(whole[:-1])[1]
    assert errors(whole + b"xyz")[2]
    flipped = bytearray(whole)
    flipped[half - 1] ^= 1  # the checksum of the first frame
    assert errors(bytes(flipped))[0] and len(errors(bytes(flipped))) == 1
    assert errors(b"") == []
