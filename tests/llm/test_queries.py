"""The registered queries without SQL, each over its whole table, against a brute-force version."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("textloom.llm")

from test_llm_operators import components_of, plain_base, plain_ids, plain_simhash  # noqa: E402
from xxhash import xxh64_intdigest  # noqa: E402

from textloom.llm import quality, queries, secret_scan, sentencepiece_codec, sharding  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    want = defaultdict(lambda: [0, 0])
    for r in texts.values():
        cell = want[r["source"], r["lang"]]
        cell[0] += 1
        cell[1] += len(plain_ids(r["text"] or ""))
    got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in result(spark, "op1_token_counts")}
    assert got == dict(want)


def test_op2(spark, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in result(spark, "op2_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    total = 0
    for i, own in pieces.items():
        ids, at = plain_ids(texts[i]["text"] or "") + [2], 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r["length"]
        assert at == len(ids)
        total += at
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 4096
    assert len(sequences) < 1.1 * total / 4096 + 8


def test_op4(spark, texts):
    fps = {i: plain_simhash(r["text"], 3) for i, r in texts.items()}
    want = components_of(fps, 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, "op4_simhash")}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


def test_op6(spark, texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    for r in result(spark, "op6_sentencepiece"):
        text = texts[r["doc_id"]]["text"] or ""
        ids = library.encode(text)
        assert (r["n_ids"], r["ids_md5"]) == (len(ids), hashlib.md5(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_placement(sizes, n_shards=8, virtual=64, slack=0.001):
    """Arcs from the heaviest on; each goes round the ring of virtual nodes, from its place, to the first shard with room."""
    ring = sorted((sharding.ring_point(f"shard {s} node {v}"), s) for s in range(n_shards) for v in range(virtual))
    cap, full, out = (1 + slack) * sum(sizes.values()) / n_shards, [0] * n_shards, {}
    for cell in sorted(sizes, key=lambda c: (-sizes[c], c)):
        walk = [s for p, s in ring if p >= cell] + [s for p, s in ring if p < cell]
        room = [s for s in walk if full[s] + sizes[cell] <= cap]
        out[cell] = room[0] if room else min(walk, key=lambda s: full[s])
        full[out[cell]] += sizes[cell]
    return out


def test_op7(spark, texts):
    got = {r["doc_id"]: r for r in result(spark, "op7_sharding")}
    raw = {i: (r["text"] or "").encode() for i, r in texts.items()}
    cell = {i: xxh64_intdigest(t, 42) >> 50 for i, t in raw.items()}
    sizes = Counter()
    for i, t in raw.items():
        sizes[cell[i]] += len(t) + 1
    assert max(sizes.values()) * 8 <= sum(sizes.values())  # no arc is split here
    where = plain_placement(sizes)
    slots = defaultdict(list)
    for i, r in got.items():
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw[i]) + 1, zlib.crc32(raw[i]), "bytes", None)
        assert r["shard"] == where[cell[i]]
        slots[r["shard"]].append(r["slot"])
    assert got.keys() == texts.keys() and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op7_moves_little():
    """With a ninth shard, bounded loads move about a ninth of the bytes and what the lower bound pushes on, not all."""
    loads = [(c, -1, 100 + c * 7919 % 900) for c in range(0, sharding.CELLS, 3)]
    before, after = sharding.place(loads, 8, 64, 0.05), sharding.place(loads, 9, 64, 0.05)
    moved = sum(size for c, p, size in loads if before[c, p] != after[c, p]) / sum(x[2] for x in loads)
    assert 0.1 < moved < 0.35


def entropy(shares):
    return -sum(x * math.log2(x) for x in shares if x)


def plain_verdict(text, lang, references):
    """Jensen-Shannon divergence as the entropy of the mean less the mean of the entropies."""
    known = references.get(lang)
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    if known is None or known[2] < 2000:
        return True

    def apart(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        raw = entropy([(x + y) / 2 for x, y in zip(p, q)]) - (entropy(p) + entropy(q)) / 2
        return raw

    plain = Counter(w.lower().strip(".,;:!?") for w in words)
    classes = quality.class_counts(text)
    common = [plain[w] for w, _ in known[1]]
    usual = [n for _, n in known[1]]
    by_class = apart(classes, known[0]) - 7 / (8 * sum(classes) * math.log(2))
    by_word = apart([*common, len(words) - sum(common)], [*usual, known[2] - sum(usual)]) - len(common) / (8 * len(words) * math.log(2))
    return max(by_class, 0) + max(by_word, 0) <= references.limit


def test_op9(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    references = quality.fit_references(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert 0 < references.limit < 0.5
    seen = set()
    for r in result(spark, "op9_quality"):
        doc = texts[r["doc_id"]]
        base = plain_base(doc["text"])
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*base, failed)
        assert r["kept"] == (not failed and plain_verdict(doc["text"], doc["lang"], references))
        seen.add((r["base_failed"], r["kept"]))
    assert seen == {(True, False), (False, True), (False, False)}


def test_fitted_limit():
    assert quality.best_limit({}, {1: 1}) == quality.LIMIT
    assert quality.best_limit({0: 9, 10: 1}, {40: 5}) == (11 + 40) / 2 / 1000
    assert quality.best_limit({0: 99, 50: 1}, {40: 5, 60: 5}) == (1 + 40) / 2 / 1000


def test_op10(spark, texts):
    kinds = [(re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8), (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]
    model = secret_scan.train(secret_scan.random_samples(), secret_scan.identifier_samples())
    names = ["assign", "access", "hex", "markov"]
    found = Counter()
    for r in result(spark, "op10_secret_scan"):
        text = texts[r["doc_id"]]["text"] or ""
        spans = [(m.start(), k, m.end()) for k, (p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least]
        more = [(m.start(), 3, m.end()) for m in re.finditer(secret_scan.CANDIDATE, text) if secret_scan.log_ratio(m[0], model) > 0.45]

        def listed(xs):
            return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(xs))

        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert r["base_sha256"] == hashlib.sha256(listed(spans).encode()).hexdigest() and r["spans"] == listed(spans + more)
        found.update(k for _, k, _ in spans + more)
    assert sum(found.values())
