"""The corpus operators against brute force, and on awkward rows: nulls, empty and long texts, ties, repeats,
empty tables, further columns."""

import hashlib
import html
import importlib.util
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

pytest.importorskip("orebody.llm.registry")

from orebody.llm import audio, byte_bpe, html_text, packing, quality_model, quality_rules, sharding, simhash, token_orc, tokens, toxicity  # noqa: E402
from orebody.llm.registry import ORACLES, QUERIES  # noqa: E402

WORDS, BYTES = tokens.vocabulary("word_bpe_49k.json"), tokens.vocabulary("byte_bpe_50k.json")
ODD = [
    None, "", " \n\t", "a", "The the THE.", "x" * 20_000, "word " * 3_000, "é ß ſ İ Σ 日本 😀‍ \x1c\x85", "don't  we'll\r\n it's<|endoftext|>x",
    "1234 5.6,7 ... !?", "same text here for all of us", "same text here for all of us", "é Å 　 half½",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, length int, label int, fp long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None, 7, 7, 7, 7) for i, t in enumerate(ODD)] + [(None, "no id", "en", "s", 1, 7, 7, 7, 7)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text FROM '{sf}/documents.parquet' ORDER BY doc_id").df()


@pytest.fixture(scope="module")
def got(spark, sf):
    made = {}

    def rows(name):
        if name not in made:
            df = QUERIES[name](spark, sf).toPandas()
            made[name] = df.sort_values(df.columns[0], kind="stable").reset_index(drop=True)
        return made[name]

    return rows


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_encoders_equal_the_library():
    rng = np.random.default_rng(0)
    bits = ["a", "B", " ", "  ", "\n", "'s", "'LL", "é", "ß", "İ", "1", "²", "日", "...", "-", "<|endoftext|>", "<|", "the", " of", " ", "\x1c", "ª", "é", "."]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(500)]
    _, words = library(WORDS, texts)
    assert tokens.WordEncoder(WORDS).encode(texts) == list(map(raw, words))
    assert tokens.WordEncoder(WORDS, memo_entries=5).encode(texts) == list(map(raw, words))
    t, pieces = library(BYTES, texts)
    encoder = byte_bpe.TrieEncoder(BYTES, memo_entries=5)
    assert [x for k in texts for x in encoder.encode([k])] == list(map(raw, pieces))
    assert [encoder.decode(raw(x)) for x in pieces] == [t.decode(x, skip_special_tokens=False) for x in pieces]


def test_token_orc(got, docs, spark, odd, none, tmp_path):
    ids = [[*x, 1] for x in library(WORDS, docs.text)[1]]
    g = got("op2_token_orc")
    assert g.doc_id.tolist() == docs.doc_id.tolist() and g.ids_crc32.tolist() == [zlib.crc32(raw(x)) for x in ids]
    assert g.start.tolist() == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()
    token_orc.write_token_orc(odd, str(tmp_path / "a"), WORDS)
    back = token_orc.read_token_orc(spark, str(tmp_path / "a"), [5])
    assert [r["ids"] for r in back.collect()] == [[*library(WORDS, [ODD[5]])[1][0], 1]]
    d = token_orc.token_orc_digest(token_orc.read_token_orc(spark, str(tmp_path / "a"))).toPandas().sort_values("start")
    assert len(d) == 15 and d.doc_id.isna().tolist()[:2] == [True, True] and d.n_tokens[d.doc_id == 0].tolist() == [1]
    token_orc.write_token_orc(none, str(tmp_path / "b"), WORDS)
    assert token_orc.token_orc_digest(token_orc.read_token_orc(spark, str(tmp_path / "b"))).count() == 0


def test_trie_bpe(got, docs, odd, none):
    t, ids = library(BYTES, docs.text)
    g = got("op3_trie_bpe")
    assert g.ids_sha256.tolist() == [hashlib.sha256(raw(x)).hexdigest() for x in ids] and g.n_tokens.tolist() == list(map(len, ids))
    assert g.decoded_sha256.tolist() == [hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest() for x in ids]
    texts = byte_bpe.bpe_decode(byte_bpe.bpe_encode(odd, BYTES), BYTES).toPandas()
    assert sorted(texts.text) == sorted([x or "" for x in ODD] + ["no id"] * 2) and byte_bpe.bpe_digest(none, BYTES).count() == 0


def slow_samples(payload, codec):
    if codec != audio.ADPCM:
        return [int(audio.EXPAND[codec][x]) for x in payload]
    out = []
    for at in range(0, len(payload), 64):
        out += slow_block(payload[at : at + 64])
    return out


def slow_block(b):
    value, index = int.from_bytes(bytes(b[:2]), "little", signed=True), min(int(b[2]), 88)
    out = [value]
    for byte in b[4:]:
        for code in (int(byte) & 15, int(byte) >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(value)
    return out


def slow_wav(payload, codec):
    def chunk(name, body):
        return name + len(body).to_bytes(4, "little") + body

    adpcm = codec == audio.ADPCM
    samples = len(payload) // 64 * 121 if adpcm else len(payload)
    numbers = [(codec, 2), (1, 2), (8000, 4), (8000 * 64 // 121 if adpcm else 8000, 4), (64 if adpcm else 1, 2), (4 if adpcm else 8, 2)]
    numbers += [(2, 2), (121, 2)] if adpcm else [(0, 2)]
    form = b"".join(v.to_bytes(n, "little") for v, n in numbers)
    return chunk(b"RIFF", b"WAVE" + chunk(b"fmt ", form) + chunk(b"fact", samples.to_bytes(4, "little")) + chunk(b"data", payload))


def test_media(got, docs, odd, none, spark):
    payloads = [t.encode() + b"\0" * (-len(t.encode()) % 64 if t else 64) for t in docs.text]
    g = got("op4_telephony")
    assert g.payload_sha256.tolist() == [hashlib.sha256(p).hexdigest() for p in payloads] and g.tail_crc32.tolist() == [zlib.crc32(p[-64:]) for p in payloads]
    codecs = [audio.CODECS[zlib.crc32(p) % 3] for p in payloads]
    media = [slow_wav(p, c) for p, c in zip(payloads, codecs)]
    assert g.media_sha256.tolist() == [hashlib.sha256(m).hexdigest() for m in media] and g.media_bytes.tolist() == list(map(len, media))
    small = [k for k, p in enumerate(payloads) if len(p) < 3_000]
    for k in small:
        x = slow_samples(payloads[k], codecs[k])
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        packed = b"".join(v.to_bytes(2, "little", signed=True) for v in x)
        want = f"{audio.NAMES[codecs[k]]};rate=8000;pcm={len(x)};rms={math.isqrt(sum(v * v for v in x) // len(x))};peak={max(map(abs, x))};crossings={crossings};crc={zlib.crc32(packed):08x}"
        assert g.feature[k] == want
    assert len(small) > 100 and {codecs[k] for k in small} == set(audio.CODECS)
    d = audio.pcm_features(audio.decode_media(audio.media_digest(audio.media_of_texts(odd)))).toPandas()
    assert len(d) == 15 and d.payload_bytes[d.doc_id == 0].tolist() == [64] and d.feature[d.doc_id == 10].tolist() == d.feature[d.doc_id == 11].tolist()
    assert audio.pcm_features(audio.decode_media(audio.media_digest(audio.media_of_texts(none)))).count() == 0


def test_media_columns(spark):
    block = bytes(range(64))
    short = audio.encode_wav(block * 3, audio.ADPCM)
    trimmed = short.replace(b"data" + (192).to_bytes(4, "little"), b"data" + (150).to_bytes(4, "little"))
    media = [audio.encode_wav(b"\x80\x00" * 8, audio.MULAW), None, b"", b"RIFFxxxxWAVE", short[:-5], short.replace(b"fmt \x14\0\0\0\x11\0\x01", b"fmt \x14\0\0\0\x11\0\x02"), trimmed]
    rows = spark.createDataFrame([(k, m, "own", "p") for k, m in enumerate(media)], "id int, sound binary, codec string, part string")
    out = {r["id"]: r for r in audio.decode_media(rows, "sound", 16_000).collect()}
    assert out[0].asDict().keys() == {"id", "sound", "part", "pcm", "codec", "media_rate", "media_error"} and out[0]["codec"] == "mulaw"
    assert np.frombuffer(out[0]["pcm"], "<i2").tolist()[:4] == [32124, 0, -32124, 0] and out[0]["media_rate"] == 8000
    assert out[1]["pcm"] is None and out[1]["media_error"] is None
    assert all(out[k]["pcm"] is None and out[k]["media_error"] for k in (2, 3, 5))
    plain = {r["id"]: r for r in audio.decode_media(rows, "sound", 8_000).collect()}
    for k, n in ((4, 187), (6, 150)):  # a last block that is cut short
        data = (block * 3)[:n]
        assert np.frombuffer(plain[k]["pcm"], "<i2").tolist() == (slow_block(data[:64]) + slow_block(data[64:128]) + slow_block(data[128:]))[:363]


def test_codecs():
    mu, a = audio.EXPAND[audio.MULAW], audio.EXPAND[audio.ALAW]
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0) and (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (20, 64), dtype=np.uint8)

    assert audio.decode_adpcm_blocks(blocks).tolist() == [slow_block(b) for b in blocks]
    assert audio.resample(np.array([0, 10, 20, 30], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 25, 30, 30]
    assert audio.resample(np.array([0, 10, 20], np.int16), 8000, 4000).tolist() == [5, 20]
    for codec in audio.CODECS:
        assert audio.parse_wav(audio.encode_wav(b"x" * 128, codec)) == (codec, 8000, 64 if codec == audio.ADPCM else 1, 242 if codec == audio.ADPCM else 128, b"x" * 128)


def test_shards(got, docs, odd, none, spark, sf):
    g = got("op5_feistel_shards")
    n = g.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert len(n) == 40 and n["count"].max() - n["count"].min() <= 1 and (n["max"] + 1 == n["count"]).all() and (n["nunique"] == n["count"]).all()
    assert g.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in docs.text] and g["size"].tolist() == [len(t.encode()) + 16 for t in docs.text]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = con.sql(ORACLES["op5_feistel_shards"]).fetchall()
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot"]
    assert sorted(r[:6] for r in rows) == sorted(map(tuple, g[names].values.tolist())) and {r[6] for r in rows} == {None}
    for size in (1, 2, 3, 7, 100, 997, 5000):
        numbers = spark.range(size).withColumnRenamed("id", "number_")
        p = [r[0] for r in numbers.select(sharding.permute(sharding.F.col("number_"), size)).collect()]
        assert sorted(p) == list(range(size)) and (size < 10 or p != sorted(p))
    s = sharding.shards(odd, 4).toPandas()
    assert len(s) == 15 and s["size"].min() == 16 and s.number_[s.doc_id.isna()].max() == 1 and sharding.shards(none).count() == 0
    assert sharding.shards(odd.repartition(7), 4).toPandas().sort_values("number_").slot.tolist() == s.sort_values("number_").slot.tolist()


def test_toxicity(spark, odd, none):
    base = "/root/testdata/sf0.01"
    g = QUERIES["op1_toxicity"](spark, base).toPandas().merge(duckdb.sql(f"SELECT doc_id, toxic AS y FROM '{base}/labels.parquet'").df())
    assert g.toxic[g.y == 1].mean() >= 0.9 and g.toxic[g.y == 0].mean() <= 0.01 and g.expected_severity.between(0, 3).all()
    labels = spark.createDataFrame([(0, None, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_severity(odd, labels)
    assert toxicity.severity(odd, model).where("toxic = 1").count() == 0 and toxicity.severity(none, model).count() == 0
    assert toxicity.drop_toxic(odd, model).count() == 15 and toxicity.drop_toxic(odd, model).columns == odd.columns
    w, b = toxicity.fit_bounds_and_weights([{0: 1}] * 20 + [{}] * 20 + [{0: 9}] * 20, np.array([1] * 20 + [0] * 20 + [3] * 20), 1)
    assert w[0] > 0 and (np.diff(b) > 0).all()


def test_quality_model(spark, odd, none):
    base = "/root/testdata/sf0.01"
    g = QUERIES["op6_ftrl_quality"](spark, base).toPandas()
    assert g.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in g.doc_id]
    h = g.merge(duckdb.sql(f"SELECT doc_id, quality FROM '{base}/labels.parquet'").df())
    h = h[h.held_out]
    assert (h.predicted == h.quality).mean() > 0.95 and len(g) == 1000
    model = quality_model.fit_quality(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    s = quality_model.quality_scores(odd, *model).toPandas()
    assert (s.score == 0.5).all() and len(s) == 15 and quality_model.quality_scores(none, *model).count() == 0


def rules_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in pd.Series(grams).value_counts().items() if n > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if g in seen for k in range(5)})


def test_rules(got, docs, spark, odd, none, sf):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(r) for r in got("op7_rule_ledger")[names].values.tolist()] == list(map(rules_of, docs.text))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(ORACLES["op7_rule_ledger"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got("op7_rule_ledger")[sorted(want.columns)].astype(str).equals(want[sorted(want.columns)].astype(str))
    book = quality_rules.ledger(odd)
    g = book.toPandas().dropna(subset=["doc_id"]).sort_values("doc_id")
    assert [tuple(r) for r in g[names].values.tolist()] == list(map(rules_of, ODD))
    assert quality_rules.ledger(none).count() == 0 and book.count() == 15
    kept = quality_rules.apply_policy(book).where("kept").count()
    assert quality_rules.keep(odd).count() == kept and quality_rules.keep(odd).columns == odd.columns
    a = {r["rule"]: r for r in quality_rules.ablation(book).collect()}
    assert a["few_words"]["kept"] == kept and a["few_words"]["failed"] >= a["few_words"]["only"]


def test_html(got, sf, spark, none):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet' ORDER BY page_id").df()
    for page, text, n in zip(pages.html, got("op8_text_density").text, got("op8_text_density").n_chars):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert text == "\n\n".join(filter(None, blocks)) and n == len(text)
    odd = """<body class=page><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div id=main><div class="post">
      <h2>A &amp; B</h2><p>First paragraph of some length here<br>goes on &lt;tag&gt;<p>Second one, with <a href='x'>a link</a>.<ul><li>one<li>two</ul></div></div>
      <div class=comments><p>nice post!</p></div><form><input name=q>search</form><script>if (a < b) { x("</p>") }</script><footer>(c)</footer>"""
    assert html_text.main_text(odd) == "A & B\n\nFirst paragraph of some length here goes on <tag>\n\nSecond one, with a link.\n\none\n\ntwo"
    for broken in ("", "<", "plain text", "<p", "</div></div>x", "<!-- open", "<a href='", "<div " * 3000, "<b>" * 3000 + "deep"):
        html_text.main_text(broken)
    rows = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>x</p>", 2), (None, "u", "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted(r["text"] for r in html_text.extract(rows).collect()) == ["", "x", "x"]


def check_packing(rows, texts, capacity=4096):
    want = []
    for key, ids in zip(texts.index, library(WORDS, texts)[1]):
        ids = [*ids, 1]
        want += [(key, k, at, len(ids[at : at + capacity]), zlib.crc32(raw(ids[at : at + capacity]))) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= capacity and s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist()
    return rows.sequence_id.nunique()


def test_packing(got, docs, odd, none):
    g = got("op9_best_fit_packing")
    n = check_packing(g, docs.set_index("doc_id").text)
    assert n <= 1.02 * g.length.sum() / 4096 + 1
    p = packing.pack_documents(odd, WORDS, 64).toPandas()
    assert p.doc_id.isna().sum() == 2 and p.groupby("sequence_id").length.sum().max() <= 64 and p.length[p.doc_id == 0].tolist() == [1]
    assert packing.pack_documents(none, WORDS).count() == 0


def test_packing_plans():
    rng = np.random.default_rng(3)
    for sizes in ([100], [100] * 7, rng.integers(1, 101, 500), rng.integers(40, 61, 300), [51] * 9 + [49] * 9, rng.integers(1, 10, 5000)):
        histogram = {int(k): int(n) for k, n in zip(*np.unique(sizes, return_counts=True))}
        plan, bins = packing.packing_plan(histogram, 100)
        load, count = {}, {}
        for length, first, pieces, sequence, each, offset in plan.tolist():
            count.setdefault(length, []).append((first, pieces))
            for k in range(pieces):
                load.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
        assert {k: sum(n for _, n in v) for k, v in count.items()} == histogram and len(load) == bins
        for places in load.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 100
        big = sum(n for k, n in histogram.items() if k > 50)
        assert bins <= 1.04 * max(big, sum(k * n for k, n in histogram.items()) / 100) + 1


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(got, docs, odd, none):
    fps = list(map(slow_fingerprint, docs.text))
    g = got("op10_simhash")
    assert g.fingerprint.tolist() == [f"{x:016x}" for x in fps] and g.component_id.tolist() == [docs.doc_id[i] for i in slow_components(fps)]
    n = simhash.near_duplicates(odd).toPandas()
    assert len(n) == 15 and n.component_id[n.doc_id.isna()].isna().all() and set(n.component_id[n.doc_id.isin([0, 1, 2])]) == {0}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == sorted([*set(n.component_id.dropna()), -1])


def test_null_ids_are_not_id_zero(spark):
    text = "the same eight words for each of these"
    for ids, want in (((None, 0), 0), ((None, 0, 0), 0), ((None, None), None), ((None, 5), 5)):
        rows = spark.createDataFrame([(i, text, 1) for i in ids], "doc_id long, text string, id_x int")
        assert [r["doc_id"] for r in simhash.keep_one(rows).collect()] == [want]


def test_bit_slices():
    rng = np.random.default_rng(5)
    for size in (2, 3, 65, 700):
        base = rng.integers(0, 2**63, size // 8 + 1, dtype=np.uint64)
        values = np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(size)], dtype=np.uint64)
        side = rng.integers(0, 2, size).astype(np.int8) if size == 65 else np.full(size, -1, np.int8)
        half = size // 2
        stop = np.where(np.arange(size) < half, half, size)
        i, j = simhash.near_links(values, stop, side)
        ok = [(a, b) for a in range(size) for b in range(a) if stop[a] == stop[b] and (side[a] < 0 or side[a] != side[b]) and (int(values[a]) ^ int(values[b])).bit_count() <= 4]

        def classes(pairs):
            top = list(range(size))
            for a, b in pairs:
                x, y = top[a], top[b]
                top = [x if t == y else t for t in top]
            return [top.index(t) for t in top]

        assert classes(zip(i.tolist(), j.tolist())) == classes(ok) and len(i) < size


def test_clashing_names_pass_through(spark):
    names = ["id_", "no_id_", "text_hash_", "nth_", "m_", "t_", "words_", "own_", "c0", "fp", "label"]
    text = "ten words that differ from each other make one fine document"
    rows = spark.createDataFrame([(1, text, *names), (2, text, *names)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    want = [(1, text, *names), (2, text, *names)]
    model = toxicity.fit_severity(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for kept, n in ((quality_rules.keep(rows), 2), (simhash.keep_one(rows), 1), (toxicity.drop_toxic(rows, model), 2)):
        assert kept.columns == rows.columns and sorted(map(tuple, kept.collect())) == want[:n]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark, sf, docs):
    import corpus_pipeline as cp

    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = all_docs
    for _, stage in cp.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == all_docs.columns and 0 < kept.count() <= before.count()
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and len(set(slow_components([slow_fingerprint(t) for t in docs.set_index("doc_id").text[ids]]))) == len(ids)
    check_packing(cp.run(spark, sf).toPandas(), docs.set_index("doc_id").text[ids])


def test_near_copies_by_jaccard(spark, odd):
    from orebody.llm import near_copies

    rng = np.random.default_rng(5)
    texts = []
    for n in rng.integers(4, 120, 60):
        words = [f"w{k}" for k in rng.integers(0, 400, n)]
        texts.append(words)
        for _ in range(3):  # one to three words of it changed: similarities on both sides of 0.8
            other = list(texts[-1])
            for at in rng.integers(0, n, rng.integers(1, 4)):
                other[at] = f"v{rng.integers(0, 400)}"
            texts.append(other)
    texts = [" ".join(t) for t in texts] + ["", " ", None]
    rows = [(i, t) for i, t in enumerate(texts)]

    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += bin(simhash.fingerprint(texts[i] or "") ^ simhash.fingerprint(texts[j] or "")).count("1") > 4
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert far > 5 and sorted(r[0] for r in kept.select("doc_id").collect()) == [i for i in range(len(texts)) if root[i] == i]
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_stage_drops_what_simhash_misses(spark):
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(200)]
    other = [*words[:60], "x", *words[61:130], "y", *words[131:]]
    one, two = " ".join(words), " ".join(other)
    assert bin(simhash.fingerprint(one) ^ simhash.fingerprint(two)).count("1") > 4
    assert [r[0] for r in cp.near_copies(spark, spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string"), "").collect()] == [1]


def test_configurations_cover_every_length():
    drawn = np.random.default_rng(1).lognormal(6.0, 1.2, 200_000).astype(np.int64) + 1
    lengths, counts = np.unique(drawn[drawn < 4096], return_counts=True)
    x = packing.solve_configurations(lengths, counts, 4096)
    cover = np.zeros(len(lengths))
    for config, times in x.items():
        assert sum(lengths[i] * k for i, k in config) <= 4096
        for i, k in config:
            cover[i] += times * k
    assert len(lengths) > 3_000 and (cover >= counts * (1 - 1e-6)).all() and len(x) <= len(lengths)
    assert sum(x.values()) <= 1.01 * (lengths * counts).sum() / 4096  # the volume is a dual bound
