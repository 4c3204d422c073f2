"""The registered queries themselves, over a folder with the messy table: their columns against brute force."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from test_llm_operators import bag, base_spans, brute_links, texts

from lexigrove.llm import queries


@pytest.fixture(scope="module")
def folder(messy, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    messy.write.parquet(f"{path}/documents.parquet")
    return path


def rows(spark, folder, name):
    return next(f for q, f in queries.QUERIES.items() if q.startswith(name + "_") or q == name)(spark, folder).collect()


def held(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 2


def test_op1(spark, folder, messy):
    out = rows(spark, folder, "op1")
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [0]
        for offset, n in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 2048
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == collections.Counter(i for i, _ in texts(messy))


def test_op2(spark, folder, messy):
    out = rows(spark, folder, "op2")
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in texts(messy))
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in out)


def test_op3(spark, folder, messy):
    out = rows(spark, folder, "op3")
    assert all(r.held_out == held(r.doc_id, 7) and r.score < 0 and r.base_score < 0 and r.n_known <= r.n_tokens for r in out)
    assert sum(r.n_tokens for r in out if not r.held_out) == out[0].train_tokens


def test_op4(spark, folder, messy):
    wanted = collections.Counter()
    for i, t in texts(messy):
        base = base_spans(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        wanted[(i, *(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")), digest)] += 1
    out = rows(spark, folder, "op4")
    assert bag((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == wanted
    for r in out:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert hashlib.sha256(",".join(":".join(x) for x in spans if x[0] in ("email", "ip", "card", "phone")).encode()).hexdigest() == r.base_sha256


def test_op5(spark, folder, messy):
    out = rows(spark, folder, "op5")
    own = collections.defaultdict(set)
    for i, t in texts(messy):
        own[i].add(bool(re.search(r"[^\W\d_]", t)))
    for r in out:
        assert r.held_out == held(r.doc_id, 4) and r.lang_pred in ("en", "xx", "und") and 0 <= r.score <= 1
        assert (r.lang_pred != "und") in own[r.doc_id]
    assert len(out) == messy.count()


def test_op6(spark, folder, messy):
    assert bag((r.doc_id, r.class_id, r.n_links) for r in rows(spark, folder, "op6")) == bag(brute_links(texts(messy)))


def test_op7(spark, folder, messy):
    """Sizes, targets by water-filling and the order of keys, all computed anew."""
    import pyspark.sql.functions as F

    from lexigrove.llm import mixing

    out = rows(spark, folder, "op7")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = collections.defaultdict(int)
    for r in messy.select("text", "source").collect():
        by[r.source] += size(r.text)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9  # the level at which min(3 size, weight * level) sums to all sizes
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * by[s], weights[s] * level) for s in order) < sum(by.values()) else (low, level)
    for r in out:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    targets = {(r.source_size, round(r.target, 3)) for r in out}
    assert targets == {(by[s], round(min(3 * by[s], weights[s] * low), 3)) for s in order}
    keyed = mixing._keyed(messy, "doc_id", "text", "source", 7, mixing.letters_weight).select("_id", "_source", "_size", F.col("_key").alias("key")).collect()
    timed = {(r.doc_id, r.size): r.times for r in out}
    for s in order:  # whole epochs for all, one more for those of the smallest keys
        mine = sorted((x.key, timed[x["_id"], x["_size"]]) for x in keyed if x["_source"] == s and x["_size"])
        assert all(a[1] >= b[1] for a, b in zip(mine[:-1], mine[1:])) and (not mine or mine[0][1] - mine[-1][1] <= 1)
    assert bag(out) == bag(rows(spark, folder, "op7"))  # reruns agree


def test_op8(spark, folder, messy):
    groups = collections.defaultdict(list)
    for i, t in texts(messy):
        groups[t].append(i)
    wanted = collections.Counter()
    for i, t in texts(messy):
        keep = max((x for x in groups[t] if x is not None), default=None)
        wanted[i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert bag((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows(spark, folder, "op8")) == wanted


def test_op9(spark, folder, messy):
    """Bytes, and the features from the standards' formulas, a sample at a time."""

    def mu(code):
        code = ~code & 255
        size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
        return -size if code & 128 else size

    def law(code):
        code ^= 0x55
        e, m = code >> 4 & 7, (code & 15) << 4
        size = m + 8 if e == 0 else (m + 264) << (e - 1)
        return size if code & 128 else -size

    said = lambda x: f"{math.sqrt(sum(v * v for v in x) / len(x)):.3f}:{sum((a < 0) != (b < 0) for a, b in zip(x[:-1], x[1:]))}"
    by = collections.defaultdict(dict)
    for r in rows(spark, folder, "op9"):
        by[r.doc_id][r.n_bytes] = r
    for i, t in texts(messy):
        data = t.encode()
        r = by[i][len(data)]
        padded = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        if len(padded) < 5000:
            parts = dict(x.split(":", 1) for x in r.feature.split(";")[1:])
            assert parts["mu"] == said([mu(c) for c in padded]) and parts["a"] == said([law(c) for c in padded])


def test_op10(spark, folder, messy):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = collections.Counter((i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for i, t in texts(messy))
    assert bag((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, folder, "op10")) == wanted


def test_pipeline(spark, folder, messy):
    """What run() gives, against its stages' rules by brute force."""
    from lexigrove.llm import exact_dedup, language_id, mixing, ngram_join

    docs = messy.select("doc_id", "text", "lang", "source", "n_chars", "id")
    kept = language_id.accepted(messy, language_id.learn(messy))
    stay = exact_dedup.drop_copies(kept)
    low = {c for _, c, _ in brute_links(texts(stay))}
    near = ngram_join.one_of_each(stay)
    assert {r.doc_id for r in near.collect()} == low
    times = collections.Counter(r.doc_id for r in mixing.take(near).collect())
    out = rows(spark, folder, "pipeline")
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == times
    assert docs.count() >= len(low)
