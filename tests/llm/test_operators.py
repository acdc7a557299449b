"""Training-data operators against brute force, libraries, round trips and held-out rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

AT = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(None, None), (None, "a b c d e"), (5, ""), (5, ""), (7, "a b c d e"), (8, "A b  c\nd e"), (9, "é"), (10, "x " * 30_000), (11, "\t\n ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{AT}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with those of operators."""
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("sid", F.lit(2)).withColumn("key", F.lit(3))


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def groups(rows, width=4):
    sets = {d: shingles(t, width) for d, t in rows}
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    found = collections.defaultdict(list)
    for d in sorted(sets):
        shared = collections.Counter(e for s in sets[d] for e in found[s])
        for s in sets[d]:
            found[s].append(d)
        for e, n in shared.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def edited_copies(n, seed=1):
    """Copies of a few texts with ever more edits: chains, hubs and pairs just under the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(4):
        base = [word() for _ in range(r.randint(20, 120))]
        for _ in range(n // 4):
            copy = list(base)
            for _ in range(r.randint(0, 8)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            if r.random() < 0.2:
                base = copy
    return list(enumerate(out))


@pytest.mark.parametrize("make", ["table", "edited"])
def test_near_duplicates_match_brute_force(spark, docs, make):
    from quillmesh.llm.minhash import near_duplicates

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if make == "table" else edited_copies(240)
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    want = groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("at_once", [1, 7, 200_000])
def test_components_match_union_find(spark, monkeypatch, at_once):
    from quillmesh.llm import minhash

    monkeypatch.setattr(minhash, "FOREST_VERTICES", at_once)
    r = random.Random(3)
    name = lambda v: bytes([v // 256, v % 256])
    edges = [(a, b) for a, b in [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)] if a != b]
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in edges], "p binary, x binary").repartition(3)
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    assert {(bytes(x.v), bytes(x.root)) for x in minhash.components(df).collect()} == {(name(v), name(find(v))) for v in up}
    assert minhash.components(df.limit(0)).count() == 0


def test_hot_keys_are_dealt_by_salts(spark, monkeypatch):
    from quillmesh.llm import minhash

    monkeypatch.setattr(minhash, "LEAST_HOT", 3)
    rows = edited_copies(240, seed=5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows)


def test_near_duplicates_of_odd_rows(spark, odd):
    from quillmesh.llm.minhash import near_duplicates

    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect())
    assert got[(5, 0, 5, True)] == 2 and got[(8, 2, 7, False)] == 1 and got[(7, 2, 7, True)] == 1 and got[(None, 2, 7, False)] == 1 and sum(got.values()) == len(ODD)
    assert near_duplicates(odd.limit(0)).count() == 0


def test_shards(spark, docs, odd):
    from quillmesh.llm.sharding import shard, shard_slots

    for df in (docs, odd):
        rows = df.collect()
        got = shard_slots(df).collect()
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 40)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    many = shard(docs, 2, bucket_rows=20)
    assert many.select("bucket").distinct().count() > 5
    order = [r.doc_id for r in many.orderBy("bucket", "place").collect()]
    assert order != sorted(order) and sorted(order) == sorted(r.doc_id for r in docs.collect())
    assert shard_slots(odd.limit(0)).count() == 0


def test_fisher_yates_is_a_uniform_permutation(spark):
    from quillmesh.llm.sharding import fisher_yates

    got = [tuple(r[0]) for r in spark.range(6000).select(fisher_yates(F.lit(3), F.col("id"))).collect()]
    counts = collections.Counter(got)
    assert len(counts) == 6 and min(counts.values()) > 850


def test_byte_bpe_equals_the_library(spark, docs, odd):
    import public_tokenizers as P
    import tiktoken

    from quillmesh.llm.bpe import decode_ids, encode_documents, encode_words, read_ranks

    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    white = spark.createDataFrame([(1, "a \n\n b\x85\xa0 c  　 d 's don't !!\x1cx"), (2, "\U0001f642 " * 9), (3, "y" * 5000)], DOCS)
    for df in (docs, odd.withColumn("n_tokens", F.lit("clash")).withColumn("ids_sha256", F.lit(1)), white, odd.limit(0)):
        want = collections.Counter()
        for r in df.collect():
            ids = own.encode_ordinary(r.text or "")
            want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
        assert collections.Counter(map(tuple, encode_documents(df, ranks, P.PATTERN).collect())) == want
    words = spark.createDataFrame([("hello",), (" été",), ("日本",), ("x",), ("",)], "word string")
    for r in encode_words(words, ranks).withColumn("back", decode_ids(F.col("ids"), ranks)).collect():
        assert r.ids == own.encode_ordinary(r.word) and bytes(r.back).decode() == r.word


def test_warc_round_trip(spark):
    from quillmesh.llm.warc import BundleReader, read_archives, write_archives

    x, y = "x" * 100, "y" * 99
    rows = [(3, "u", x), (1, "http://a b\n", x), (2, "u", x), (1, "again", x), (None, None, x), (4, "u", y), (5, "u", y), (6, None, None), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    bundles = write_archives(pages)
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read_archives(bundles).collect())
    assert got == collections.Counter([(3, 100, "revisit", 1), (1, 100, "response", None), (1, 100, "response", None), (2, 100, "revisit", 1), (None, 100, "revisit", 1), (4, 99, "response", None), (5, 99, "response", None), (6, 0, "response", None), (7, 0, "response", None)])
    raw = bytes(bundles.first().bundle)
    fields, block = next(x for x in (BundleReader(bytes(b.bundle)).find("urn:page:4") for b in bundles.collect()) if x)
    assert block.endswith(y.encode()) and fields["WARC-Type"] == "response" and len(raw) > 0
    assert read_archives(write_archives(pages.limit(0))).count() == 0


def test_warc_of_very_long_payloads(spark):
    from quillmesh.llm.warc import read_archives, write_archives

    rows = [(1, "u", "z" * 9_000_000), (2, "u", "z" * 9_000_000), (3, "u", "y" * 20_000_000)]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in read_archives(write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got == {k: (len(t), hashlib.sha256(t.encode()).hexdigest(), 1 if k == 2 else None) for k, _, t in rows}


def test_encoders_are_kept_by_their_vocabulary():
    from quillmesh.llm import bpe

    letters = {bytes([k]): k for k in range(256)}
    a, b = {**letters, b"ab": 256}, {**letters, b"bc": 256}
    ids = [[np.frombuffer(raw, "<u4").tolist() for raw in bpe.text_encoder(bpe.vocabulary_key(r, "(?s).+", {}), r, "(?s).+", {})(["abc"])] for r in (a, b)]
    assert ids == [[[256, 99]], [[97, 256]]]


def test_bundles_are_plain_zstandard():
    import io

    import zstandard

    from quillmesh.llm import warc

    w = warc.BundleWriter()
    records = [warc.record(i, "u", bytes([i]) * 90_000, "d", None) for i in range(9)]
    for i, r in enumerate(records):
        w.add(f"urn:page:{i}", r)
    raw = w.bundle()
    assert len(w.sizes) > 2
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(records)
    assert warc.BundleReader(raw).find("urn:page:8")[1].endswith(bytes([8]) * 90_000)


def test_fingerprints_match_brute_force(spark, docs, monkeypatch):
    from quillmesh.llm import fingerprints as fp

    monkeypatch.setattr(fp, "PART_ROWS", 20)
    got = {r.doc_id: r for r in fp.fingerprint_documents(docs).collect()}
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    for k, r in enumerate(order):
        after = order[(k + 1) % len(order)].text
        edited = r.text[: len(r.text) - len(r.text) // 2] + after[: len(r.text) // 2]
        g = got[r.doc_id]
        assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (g.fingerprint, g.edited_fingerprint) == (fp.fingerprint(fp.Prefixes(r.text)), fp.fingerprint(fp.Prefixes(edited)))
        assert 0 <= g.near_next <= 1 and g.near_edited >= 0.4


def test_fingerprints_of_odd_rows(spark, odd):
    from quillmesh.llm import fingerprints as fp

    got = fp.fingerprint_documents(odd).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in ODD)
    assert fp.fingerprint_documents(odd.limit(0)).count() == 0
    one = fp.fingerprint_documents(odd.filter("doc_id = 9")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("part_rows", [2, 7, 10_000])
def test_fingerprints_where_ids_are_null_or_repeat(spark, monkeypatch, part_rows):
    from quillmesh.llm import fingerprints as fp

    monkeypatch.setattr(fp, "PART_ROWS", part_rows)
    rows = [(None, f"no id {k}") for k in range(30)] + [(7, f"seven {k % 9}") for k in range(30)] + [(k, f"own {k}") for k in range(-5, 5)] + [(2**62, None), (-(2**63), "least")]
    df = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("x")).withColumn("look", F.lit(1)).withColumn("k", F.lit(2)).withColumn("lane", F.lit(3)).repartition(5)
    hashes = {r.text: r.h for r in spark.createDataFrame(rows, DOCS).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), hashes[r[1]] % 2**64))
    edited = lambda a, b: a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    want = collections.Counter()
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        want[(doc_id, len(text), hashlib.sha256(edited(text, after).encode()).hexdigest(), round(fp.likeness(fp.fingerprint(fp.Prefixes(text)), fp.fingerprint(fp.Prefixes(after))), 9))] += 1
    got = fp.fingerprint_documents(df)
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_next, 9)) for r in got.collect()) == want


def test_spans_and_extensions():
    from quillmesh.llm.fingerprints import Prefixes, equal, extension

    a, b = Prefixes("xxabcdefgh"), Prefixes("abcdefzz")
    assert equal(a, 2, b, 0, 6) and not equal(a, 2, b, 0, 7) and extension(a, 2, b, 0) == 6 and extension(a, 0, b, 0) == 0


def test_matroska_columns(spark, docs, odd):
    from quillmesh.llm.matroska import media_columns

    for df in (docs, odd):
        want = collections.Counter()
        for r in df.collect():
            raw = (r.text or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            want[(r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
        assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media_columns(df).collect()) == want
    assert media_columns(odd.limit(0)).count() == 0


def test_matroska_parser_reads_other_writers_forms():
    from quillmesh.llm import matroska as m

    frames = [b"a" * 300, b"b" * 5, b"c" * 700]
    xiph = b"\x02\x02" + b"\xff\x2d" + b"\x05" + b"".join(frames)
    ebml = b"\x06\x02" + m.vint(300, 2) + (5 - 300 + 8191 | 1 << 14).to_bytes(2, "big") + b"".join(frames)
    block = lambda body: m.element(m.SIMPLE_BLOCK, b"\x81\x00\x07" + body)
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\xff\xfe\x00" + b"z"))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.TIMECODE, 10) + block(xiph) + block(ebml) + group
    raw = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + m.element(m.CLUSTER, m.number(m.TIMECODE, 20) + block(b"\x00q"))
    media = m.demux(raw)
    assert [raw[s : s + n] for _, _, s, n in media.packets] == [*frames, *frames, b"z", b"q"]
    assert [t // 1_000_000 for _, t, _, _ in media.packets] == [17] * 6 + [8, 27] and len(media.clusters) == 2


def test_packing_keeps_every_id_once(spark, docs, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from quillmesh.llm.packing import pack_documents

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    special = spark.createDataFrame([(100, "<|endoftext|>y, <|ENDOFTEXT|> İstanbul ΑΣ. it's 123abc,. é \x1cx")], DOCS)
    df = docs.select("doc_id", "text").union(odd.filter("doc_id not in (5)").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10_000)).union(special.withColumn("doc_id", F.lit(-1).cast("long")))
    pieces, sequences, padding = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in pack_documents(df, P.path("word_bpe_49k.json")).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in df.collect():
        ids = np.array([*own.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 2048 * df.rdd.getNumPartitions()
    assert pack_documents(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_of_repeated_rows(spark, odd):
    import public_tokenizers as P

    from quillmesh.llm.packing import pack_documents

    df = odd.union(odd).withColumn("start", F.lit("clash")).withColumn("sequence_id", F.lit(2))
    got = pack_documents(df, P.path("word_bpe_49k.json")).collect()
    assert collections.Counter(r.doc_id for r in got if r.start == 0) == collections.Counter(d for d, _ in ODD + ODD)
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_extraction(spark):
    from quillmesh.llm.extraction import extract_pages

    page = lambda body: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><div>Site motto</div><div class='cookie-notice'>ok?</div>{body}<div class=comments><p>nice</p></div><aside>more</aside><footer>&copy; x</footer></body></html>"
    rows = [(k, "http://H.example/x", page(f"<div><h2>Title {k}</h2><p>Some&nbsp; text &lt;{k}&gt;<br>line<p>More {k}</div>")) for k in range(6)]
    rows += [(6, "http://other/", page("<article><header><h1>T</h1></header><p>A</p><form>f</form></article>")), (7, None, None), (8, "x", ""), (8, "x", ""), (9, "http://h.example/", "plain <b>words</b> <scr")]
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    for k in range(6):
        want = f"Title {k}\n\nSome text <{k}> line\n\nMore {k}"
        assert got[k] == (want, len(want))
    assert got[6][0] == "T\n\nA" and got[7] == got[8] == ("", 0) and got[9][0] == "plain words"


def test_tree_matching_weight_equals_brute_force():
    from quillmesh.llm.extraction import Matcher, parse

    def stm(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + stm(x, y))
        return 1 + best[-1][-1]

    r = random.Random(5)
    tree = lambda d: "".join(f"<{t}>{tree(d - 1) if d else 'x'}</{t}>" for t in r.choices(["div", "ul", "b"], k=r.randint(0, 3)))
    for _ in range(40):
        m = Matcher()
        a, b = m.sign(parse(tree(3))), m.sign(parse(tree(3)))
        assert len(m.pairs(a, b)) == m.weight(a, b) == stm(a, b)


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, which):
    from quillmesh.llm import quality, toxicity

    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = (quality.classify_quality if which == "quality" else toxicity.classify_toxicity)(labelled, labels)
    rows = out.filter("held_out").join(labels, "doc_id").select("score", "predicted", F.col(which).alias("y")).collect()
    pos, neg = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    order = np.argsort(np.argsort(pos + neg))
    auc = (order[: len(pos)].sum() - len(pos) * (len(pos) - 1) / 2) / (len(pos) * len(neg))
    assert auc > (0.98 if which == "quality" else 0.9)
    assert np.mean([r.predicted == r.y for r in rows]) > 0.93


def test_classifiers_of_odd_rows_and_without_labels(spark, odd):
    from quillmesh.llm import quality, toxicity

    labels = spark.createDataFrame([(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    for classify in (quality.classify_quality, toxicity.classify_toxicity):
        got = classify(odd, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert classify(odd.limit(0), labels.limit(0)).count() == 0
    kept = quality.quality_scores(odd, quality.train(odd, labels))
    assert kept.schema["score"].dataType.simpleString() == "double" and "shard" in kept.columns


def test_gradients_match_differences():
    from quillmesh.llm.toxicity import GatedNetwork

    r = np.random.default_rng(0)
    net = GatedNetwork()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    steps, live, y = r.integers(0, 5, (32, 3)), np.ones((32, 3)), np.array([1.0, 0.0, 1.0])
    live[20:, 1] = 0
    x = r.normal(0, 1, (5, net.p["in"].shape[0]))

    def loss():
        z = net.forward(x @ net.p["in"], steps, live)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    tape: dict = {}
    z = net.forward(x @ net.p["in"], steps, live, tape)
    g, dproj = net.gradients(steps, live, tape, (1 / (1 + np.exp(-z)) - y) / 3, 5)
    g["in"] = x.T @ dproj
    for k, d in g.items():
        at = tuple(int(r.integers(0, n)) for n in net.p[k].shape)
        kept = net.p[k][at]
        net.p[k][at] = kept + 1e-3
        up = loss()
        net.p[k][at] = kept - 1e-3
        down = loss()
        net.p[k][at] = kept
        assert abs((up - down) / 2e-3 - d[at]) < 2e-3, k


def test_factorisation_identity():
    from quillmesh.llm.quality import FactorisationMachine

    m = FactorisationMachine()
    r = np.random.default_rng(1)
    m.w = r.normal(0, 1, m.w.shape)
    i, x = np.array([3, 17, 40_000 % len(m.w), 5]), np.array([0.5, 1.0, 2.0, 0.1])
    z, _ = m.logits(np.array([0, 4]), i, x)
    want = m.w0 + (m.w[i] * x).sum() + sum(float(m.v[a] @ m.v[b]) * x[p] * x[q] for p, a in enumerate(i) for q, b in enumerate(i) if p < q)
    assert abs(z[0] - want) < 1e-4


def test_toxicity_features_hold_words_not_scratch():
    """Peak memory over many blocks of texts grows by little more than their words' places, and each text's features are those it has alone."""
    import tracemalloc

    from quillmesh.llm import toxicity

    r = np.random.default_rng(4)
    vocab = np.array([f"w{k}" for k in range(60_000)])
    texts = [" ".join(vocab[r.integers(0, len(vocab), 10_000)]).encode() for _ in range(200)]

    def peak(raw):
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw])))
        tracemalloc.start()
        got = toxicity.Inputs()(data, offs)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, got

    (few, _), (many, (at, step, bucket, ptr, grams)) = peak(texts[:50]), peak(texts)
    assert many - few < 6 * sum(map(len, texts[50:]))  # 13 times, where all blocks' arrays are held together
    for k in (0, 77, 199):
        _, (_, s, b, p, g) = peak(texts[k : k + 1])
        mine = step[at[k] : at[k + 1]]
        assert (bucket[mine] == b[s]).all()
        assert all((grams[ptr[x] : ptr[x + 1]] == g[p[y] : p[y + 1]]).all() for x, y in zip(mine[:300], s[:300], strict=True))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{AT}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        before, left = left, stage(spark, left, AT)
        if name != "packing":
            assert left.columns == docs.columns
            assert {r.doc_id for r in left.collect()} <= {r.doc_id for r in before.collect()}
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            assert {r.doc_id for r in left.collect()} == {d for d, (_, c) in groups(rows, 5).items() if c == d}
            kept = {r.doc_id for r in left.collect()}
    assert {r.doc_id for r in left.collect()} == kept
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_near_dedup_drops_by_row(spark):
    import corpus_pipeline

    copy, own, other = ("a b c d e f g h", "own words of a row without an id", "other words of the id that repeats")
    rows = [(1, copy), (1, copy), (None, copy), (None, own), (None, own), (None, None), (2, copy), (2, other), (3, None), (3, None), (4, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("rid", F.lit("clash")).withColumn("stays", F.lit(1)).withColumn("rows", F.lit(2)).withColumn("_row", F.lit(3))
    got = corpus_pipeline.near_dedup(spark, df, AT)
    assert got.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(1, copy), (None, own), (None, None), (2, other), (3, None), (3, None), (4, "")])


def test_near_dedup_keeps_one_of_a_group_without_ids(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join(words[:-1] + ["x"])), (7, "far other words than those above here")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), AT).collect()
    assert len(got) == 2 and (7, rows[2][1]) in {(r.doc_id, r.text) for r in got}
    same_id = [(5, rows[0][1]), (5, rows[1][1])]
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(same_id, DOCS), AT).count() == 1


@pytest.mark.parametrize("stage", ["quality", "toxicity", "near_dedup", "packing"])
def test_stages_of_odd_rows(spark, odd, stage):
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, odd, AT)
    rows = got.collect()
    if stage == "packing":
        assert collections.Counter(r.doc_id for r in rows if r.start == 0) == collections.Counter(d for d, _ in ODD)
    else:
        assert got.columns == odd.columns
        assert not collections.Counter((r.doc_id, r.text) for r in rows) - collections.Counter(ODD)
    if stage == "near_dedup":
        # Three rows have the words a to e; empty texts and those without words stay.
        assert len(rows) == len(ODD) - 2
    assert run(spark, odd.limit(0), AT).count() == 0


def test_run_equals_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from quillmesh.llm import quality, toxicity

    docs, labels = spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet")
    good = {r.doc_id for r in quality.classify_quality(docs, labels).filter("score >= 0.5").collect()}
    clean = {r.doc_id for r in toxicity.classify_toxicity(docs, labels).filter(F.col("score") < toxicity.THRESHOLD).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good & clean}
    stay = {d for d, (n, c) in groups(texts.items(), 5).items() if c == d or not n}
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, AT).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == stay and stay
    for d, rows in pieces.items():
        ids = np.array([*own.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_extraction_of_many_layouts_of_a_host(spark):
    from quillmesh.llm.extraction import extract_pages

    tags = "dl ol ul table section h3 h4 h5 h6 pre blockquote".split()
    block = lambda tag, k: f"<body><article>{''.join(f'<{tag} class=c{i}>{x}</{tag}>' for i, x in enumerate((f'Standing {tag}', f'varies {k}', f'also {k}')))}</article></body>"
    rows = [(100 * t + k, "http://h/", block(tag, 100 * t + k).replace("class=c", f"class={tag}")) for k in range(6) for t, tag in enumerate(tags)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {k: f"varies {k}\n\nalso {k}" for k, _, _ in rows}


@pytest.mark.parametrize(
    "pages,body,want",
    [
        (6, "<article><p>one {k}</p></article><article><p>two {k}</p></article>", "one {k}\n\ntwo {k}"),
        (6, "<main><p>before {k}</p><article><p>in {k}</p></article><p>after {k}</p></main>", "before {k}\n\nin {k}\n\nafter {k}"),
        (6, "<article><p>teaser {k}</p></article><div><p>a long text of page {k}</p></div>", "teaser {k}\n\na long text of page {k}"),
        (6, "<article><p>{k}</p><p>far more standing text than there is of the article</p></article>", "{k}"),
        (1, "<article><p>one</p></article><article><p>two</p></article>", "one\n\ntwo"),
        (1, "<main><p>before</p><article><p>in</p></article><p>after</p></main>", "before\n\nin\n\nafter"),
        (1, "<article><p>teaser</p></article><div><p>a long text beside it</p></div>", "teaser\n\na long text beside it"),
    ],
)
def test_extraction_takes_all_slots(pages, body, want):
    from quillmesh.llm import extraction as x

    matcher, layouts = x.Matcher(), []
    html = [f"<html><body>{body.format(k=k)}</body></html>" for k in range(pages)]
    for page in html:
        x.place(matcher, layouts, matcher.sign(x.as_template(x.parse(page))))
    layouts = [t for t in layouts if t.total >= x.LEAST_PAGES]
    assert [x.main_text(page, layouts, matcher) for page in html] == [want.format(k=k) for k in range(pages)]


def test_texts_of_most_pages_are_constant():
    from quillmesh.llm import extraction as x

    matcher, layouts = x.Matcher(), []
    html = [f"<body><p>text {k}</p><p>{'standing' if k % 5 < 3 else f'own {k}'}</p></body>" for k in range(100)]
    for page in html:
        x.place(matcher, layouts, matcher.sign(x.as_template(x.parse(page))))
    assert [x.main_text(page, layouts, matcher) for page in html] == [f"text {k}" if k % 5 < 3 else f"text {k}\n\nown {k}" for k in range(100)]


def test_likeness_counts_spans_within():
    from quillmesh.llm import fingerprints as fp

    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(1000)]
    mark = lambda at: fp.fingerprint(fp.Prefixes(" ".join("changed" if k in at else w for k, w in enumerate(words))))
    other = fp.fingerprint(fp.Prefixes(" ".join(r.sample(words[::-1], 500) + ["".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(500)])))
    assert fp.likeness(mark(()), mark((3, 996))) > 0.95 and fp.likeness(mark(()), mark(range(5, 1000, 100))) > 0.85
    assert fp.likeness(mark(()), other) < 0.3
    assert fp.likeness(fp.fingerprint(fp.Prefixes("")), mark(())) == 0


def test_run_cache_matches_library():
    """Whole texts by the library itself, over letters whose case or normal form is more than a letter, and a cache that turns over."""
    import public_tokenizers

    from quillmesh.llm.wordids import CachedIds

    cached = CachedIds(public_tokenizers.path("word_bpe_49k.json"), most=2000)
    assert cached.folds
    r = random.Random(5)
    odd = "aAbJ\u030c\u0130\u03a3\u03c3\u03c2\u00c9e\u0301\u00df\u01c5\u0915\u093c\u0958.,'\"<|>$#@sS tT\n\t\x0b\x0c\x1c\u3000\xa01\u0662\uff13\u65e5\ufb01K\u0338=<"
    texts = ["".join(r.choice(odd) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|> x<|startoftext|>. <|EndOfText|>", "It's DON'T. we'll' '' 's'S", "", "\u0130stanbul. \u039f\u0394\u039f\u03a3. \u0130, \u0958. Stra\u00dfe!! 3, ##,"]
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        want = [np.array(cached.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert cached(part) == want
