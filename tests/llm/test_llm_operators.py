"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import pickle
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from lexigrove.llm import exact_dedup, language_id, lm_scoring, mixing, ngram_join, packing, pii, quality, telephony, token_counts


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_packing(messy, empty):
    out = packing.pack_documents(messy).collect()
    coder, wanted = packing.encoder(), collections.Counter()
    from tokenizers import Tokenizer
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts(messy):
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert ids[:-1].tolist() == coder.ids(t).tolist()
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > first else [0, len(ids)]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            wanted[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == wanted
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in out) / 2048) + 1
    assert packing.pack_documents(empty).collect() == []


def test_packing_plan():
    r = np.random.default_rng(3)
    for n in (1, 7, 60, 3000):
        counts = np.bincount(r.integers(1, 200, n), minlength=201)
        plan = packing.plan(counts, 200)
        used = collections.Counter()
        for parts, times in plan:
            assert sum(parts) <= 200 and times > 0
            for x in parts:
                used[x] += times
        assert all(used[k] == counts[k] for k in range(1, 201))
        assert sum(t for _, t in plan) <= math.ceil(sum(k * c for k, c in enumerate(counts)) / 200) * 1.1 + 1
    counts = np.zeros(101, int)
    counts[[60, 25, 15]] = 4  # filled exactly by pairs
    assert packing.plan(counts, 100) == [((60, 25, 15), 4)]
    counts = np.zeros(101, int)
    counts[[41, 30, 19, 10]] = 1  # filled exactly by a triple
    assert packing.plan(counts, 100) == [((41, 30, 19, 10), 1)]
    assert packing.plan(np.zeros(11, int), 10) == []


def test_special_tokens_and_odd_characters():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    for t in ["<|endoftext|>", "a<|endoftext|>b", "😀 漢字 Ᲊ", "a\x00b\x1c c", "   x  \n\n y", "it's 12 $$$"]:
        assert coder.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_quality(messy, empty):
    df, learned = quality.classify(messy)
    out = df.collect()
    assert len(out) == messy.count() and learned["documents"] == len(out)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.keep == (r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[10].keep and not by[61].keep and by[61].score == by[60].score
    assert quality.classify(empty)[0].collect() == []


def test_quality_em_recovers_accuracies():
    r = np.random.default_rng(1)
    n = 20000
    kind = r.choice([0, 1, 2], n, p=[0.8, 0.12, 0.08])  # good, bad as labeller 0 sees it, bad as labeller 1 sees it
    votes = np.ones((n, 3), int)
    votes[:, 0] = np.where((kind == 1) & (r.random(n) < 0.97), 0, votes[:, 0])
    votes[:, 1] = np.where((kind == 2) & (r.random(n) < 0.97), 0, votes[:, 1])
    votes[:, 2] = np.where(r.random(n) < 0.3, -1, np.where((kind > 0) & (r.random(n) < 0.6), 0, 1))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy, share = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05 and ((posterior[inverse.ravel()] > 0.5) == (kind == 0)).mean() > 0.97
    assert accuracy[0, 1] > 0.97 and abs(accuracy[2, 0] - 0.6) < 0.15


def test_lm_scoring(messy, empty):
    df, learned = lm_scoring.score(messy)
    out = {(r.doc_id, r.n_tokens): r for r in df.collect()}
    words = lambda t: [*re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split(), "end"]
    counts = collections.Counter()
    for i, t in texts(messy):
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    assert (learned["train_tokens"], learned["types"]) == (n, v)
    for i, t in texts(messy):
        r = out[i, len(words(t))]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.n_known == sum(counts[w] > 0 for w in words(t)) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), rel_tol=1e-9)
        assert r.score < 0
    assert lm_scoring.score(empty)[0].collect() == []


def lm(words, seed=1, drop=0):
    """A model with counts of a text of random words, and the text's ids; the last ``drop`` are not counted."""
    r = np.random.default_rng(seed)
    ids = np.concatenate([np.append(r.permutation(np.repeat(np.arange(40), 1 + np.arange(40) // 4)), lm_scoring.END) for _ in range(words)])
    firsts = np.concatenate([[0], np.flatnonzero(ids == lm_scoring.END) + 1])
    m = lm_scoring.Model(np.bincount(ids, minlength=lm_scoring.VOCABULARY + 1))
    y = m.classes[ids]
    m.gather(lm_scoring._tally(m, y, firsts, None).reshape(3, lm_scoring.CLASSES, lm_scoring.CLASSES))
    pairs = lm_scoring._tally_pairs(m, y, firsts, None)
    m.gather_pairs(np.flatnonzero(pairs), pairs[pairs > 0])
    return m, ids, firsts


def lm_by_hand(m, ids, i, begin, y):
    """p(class y | what a window sees of the classes before place ``i``), by loops."""
    c = [0, *m.classes[ids].tolist()]  # the class before each place of the only text
    x, w = c[i], m.w
    table, n, level = m.values()
    state = x * lm_scoring.KINDS + m.kind[c[i - 1] if i else 0]
    following = (m.next[x, y] + 5 * m.u[y]) / (m.next_n[x] + 5)
    paired = (table[state * lm_scoring.CLASSES + y] + 10 * following) / (n[state] + 10)
    parts = [(float(w["level"][level[state]] + w["pair"][x]), paired), (float(w["own"][x]), following), (float(w["none"][0]), m.u[y])]
    for j in range(max(0, begin), i + 1):
        logit = float((m.e[x] @ w["q"]) @ (m.e[c[j]] @ w["k"]) + w["distance"][i - j])
        parts.append((logit, m.z[c[j], :-1] @ m.o[:, y]))
    return sum(math.exp(a) * v for a, v in parts) / sum(math.exp(a) for a, _ in parts)


def test_lm_against_loops():
    m, ids, firsts = lm(1)
    r = np.random.default_rng(2)
    for name in ("q", "k", "pair", "own"):
        m.w[name] = r.normal(0, 0.3, m.w[name].shape).astype(np.float32)
    got = m.logs(ids, firsts)
    told = lm_scoring.STRIDE
    for i in [0, 1, 5, 23, 24, 25, 47, 60, 100, len(ids) - 1]:
        begin = i // told * told - (lm_scoring.CONTEXT - told)
        p = lm_by_hand(m, ids, i, begin, m.classes[ids[i]])
        assert math.isclose(got[i], math.log(p) + m.inside[ids[i]], rel_tol=1e-4, abs_tol=1e-4)
    for i in (0, 30, 70):
        begin = i // told * told - (lm_scoring.CONTEXT - told)
        assert math.isclose(sum(lm_by_hand(m, ids, i, begin, y) for y in range(lm_scoring.CLASSES)), 1, abs_tol=1e-3)
    total = np.bincount(m.classes, np.exp(m.inside.astype(float)), lm_scoring.CLASSES)
    assert np.allclose(total[np.unique(m.classes)], 1, atol=1e-3)


def test_lm_is_causal_and_sees_its_own_text_only():
    m, ids, _ = lm(3)
    a = ids[:150]
    b = a.copy()
    b[60:] = 7
    one, other = (m.logs(x, np.array([0, 150])) for x in (a, b))
    assert np.allclose(one[:60], other[:60], atol=1e-5) and not np.allclose(one[60:], other[60:])
    both = m.logs(np.concatenate([a, b]), np.array([0, 150, 300]))
    assert np.allclose(both, np.concatenate([one, other]), atol=1e-5)


def test_lm_gradient():
    """A step follows the slope of the loss without the place itself among the counts."""
    m, ids, firsts = lm(2)
    y = m.classes[ids]
    x, s = m.states(y, firsts)
    seen, at, used = lm_scoring.places(lm_scoring.windows(firsts)[:4], x)

    def loss(model):
        model.ready()
        _, paired_e, own_e, none_e, paired, following, u = model.own(seen[:, -lm_scoring.STRIDE :], s[at], y[at], 1)
        got = model.attend(seen)[2].astype(float) @ model.z[seen]
        upper = paired_e * paired + own_e * following + none_e * u + (got * model.o_by_class[y[at]]).sum(2)
        return -np.log(upper / (paired_e + own_e + none_e + got[..., -1]))[used].mean()

    t = lm_scoring.Trainer(m, 0.0)
    t.step(seen, s[at], y[at], used)
    slope = t.m / 0.1 * -1  # the first moment after one step
    flat = m.flat()
    for k in [3, 40, 100, 300, 500, *range(512, 520), 545, 600, len(flat) - 1]:
        by = []
        for d in (-0.02, 0.02):
            moved = flat.copy()
            moved[k] += d
            m.take(moved)
            by.append(loss(m))
        assert math.isclose((by[1] - by[0]) / 0.04, slope[k], rel_tol=0.05, abs_tol=2e-5), k


def test_lm_learns():
    m, ids, firsts = lm(30)
    y = m.classes[ids]
    t = lm_scoring.Trainer(m, 0.03)
    for _ in range(40):
        t.n, t.loss = 0, 0.0
        t.one_pass(y, firsts)
        first = t.loss / t.n if t.t < 3 else first
    assert t.n == len(ids) and t.loss / t.n < first - 0.02


def test_lm_subwords_of_words():
    coder = lm_scoring.encoder()
    words = ["the", "it's", "l'été", "x\u00a0y", "\u00a0z", "a\u2028", "\x1cq", "漢字", "\u3000b", "…", "don't", "12ab!!", "\x00", "e\u0301"]
    spelled = np.frombuffer("".join(words).encode(), np.uint8)
    ids, firsts = lm_scoring.subwords(spelled, np.array([len(w.encode()) for w in words]), coder)
    assert [ids[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:])] == [coder.encode_ordinary(" " + w) for w in words]
    none, firsts = lm_scoring.subwords(np.zeros(0, np.uint8), np.zeros(0, np.int64), coder)
    assert len(none) == 0 and firsts.tolist() == [0]


def test_lm_weights_are_fitted_on_every_training_subword(spark, monkeypatch):
    rows = [(i, f"word{i % 9} and text {i}", "en") for i in range(1800)] + [(5000, "long text " * 700, "en"), (5001, "long text " * 900, "en")]
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 8 << 10)  # several blocks
    df, learned = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert learned["fitted"] == df.where("not held_out").agg({"n_subwords": "sum"}).first()[0]
    assert 0 < learned["loss"] < 4
    again = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0].collect()}
    assert all(math.isclose(again[r.doc_id].base_score, r.base_score, rel_tol=1e-9) for r in df.collect())  # whatever the blocks


CODE_BLOCKS = """
import re
import numpy as np, pyarrow as pa, pyspark
from lexigrove.llm import lm_scoring

pyspark.TaskContext.get = classmethod(lambda cls: cls)
pyspark.TaskContext.partitionId = classmethod(lambda cls: 0)
held = lambda: sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
numbers = np.random.default_rng(1).zipf(1.3, 400_000) % 300_000
texts = [" ".join(f"w{x}" for x in part) for part in np.split(numbers, 400)] * 10
batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array([True] * len(texts))], ["id", "t", "learn"])
del numbers, texts
for _ in lm_scoring._code(iter([batch.slice(0, 10)])):
    pass
before, rows = held(), 0
for out in lm_scoring._code(iter([batch])):
    rows += out.num_rows
del out
assert rows > 4
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_lm_coding_keeps_no_free_memory():
    run = subprocess.run([sys.executable, "-c", CODE_BLOCKS], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=300)
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < 40


def test_lm_models_are_sent_small():
    m, _, _ = lm(1)
    keys = np.random.default_rng(1).permutation(lm_scoring.CLASSES * lm_scoring.KINDS * lm_scoring.CLASSES)[:1_000_000]
    less = len(pickle.dumps(m))
    m.gather_pairs(keys, keys % 5 + 1)
    assert len(pickle.dumps(m)) - less < 2_000_000
    table, n, _ = pickle.loads(pickle.dumps(m)).values()
    assert np.array_equal(table[keys], keys % 5 + 1) and table.sum() == n.sum() == (keys % 5 + 1).sum()


def test_lm_counts_of_all_tasks_are_summed(spark, monkeypatch):
    rows = [(i, " ".join(f"word{i * j % 97}" for j in range(i % 50)), "en") for i in range(900)]
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 8 << 10)
    df, learned = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    total = df.where("not held_out").agg({"n_subwords": "sum"}).first()[0]
    m = learned["model"]
    assert m.next_n.sum() == m.next.sum() == total
    assert m.values()[0].sum() == m.values()[1].sum() == total
    by_class = m.values()[0].reshape(lm_scoring.CLASSES, lm_scoring.KINDS, lm_scoring.CLASSES).sum(1)
    assert np.array_equal(by_class, m.next)  # two passes over the same texts


def test_lm_windows_overlap_by_a_quarter():
    assert lm_scoring.CONTEXT - lm_scoring.STRIDE >= lm_scoring.CONTEXT // 4


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for kind, rx in BASE:
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii(spark, messy, empty):
    more = [
        "a@b.c%d@e.f x 1.2.3.4.5.6.7.8 😀 +1 (555) 123-4567 me@x.y", "@@a@b.cc", "x" * 3000, "1" * 2000, "a@b" + ".c" * 3000, "256.1.1.1 0001.2.3.255 +1234567", "4111 1111 1111 1111",
        "4111-1111-1111-1112", "IBAN DE89 3704 0044 0532 0130 00", "GB82WEST12345698765433", "my SSN 123-45-6789", "id 123-45-6789", "1.1.1.1.1.1.1.1" * 3, "a@b.c@d.e.f@g.h", "+ +1 2 +49 30 123456789.", "",
    ]
    df = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").unionByName(messy.select("doc_id", "text"))
    out = pii.find_pii(df.withColumn("found", df.text)).collect()
    wanted = collections.defaultdict(list)
    for i, t in texts(df):
        wanted[i].append(base_spans(t))
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r.found if s.kind in pii.BASE] in wanted[r.doc_id]
    extra = {s.match for r in out for s in r.found if s.kind not in pii.BASE}
    assert extra == {"DE89 3704 0044 0532 0130 00", "123-45-6789"}
    assert pii.find_pii(empty).collect() == []
    masked = pii.mask(spark.createDataFrame([("call a@b.co or 10.0.0.1 now",), (None,)], "text string")).collect()
    assert [r.text for r in masked] == ["call <email> or <ip> now", None]


def test_pii_in_texts_of_many_matches(spark):
    """Blocks of matches: spans, contexts and masks as by hand, in time that follows the text."""
    many = "".join(f"mail a{k}@b.co 😀 1.2.3.{k % 300}{' SSN' * (k % 7 == 0)} {100 + k % 500}-12-3456, +1 (555) 123-45{k % 100:02d}; " for k in range(3000))
    df = spark.createDataFrame([(1, many), (2, "x" + many)], "doc_id int, text string")
    for r in pii.find_pii(df).collect():
        text = many if r.doc_id == 1 else "x" + many
        assert [(s.kind, s.start, s.end) for s in r.found if s.kind in pii.BASE] == base_spans(text)
        assert all(text[s.start : s.end] == s.match for s in r.found)
        for s in r.found:
            near = text[max(0, s.start - pii.WINDOW) : s.start] + " " + text[s.end : s.end + pii.WINDOW]
            assert math.isclose(s.score, min(1, pii.SCORES[s.kind] + 0.3 * bool(re.search(pii.CONTEXT[s.kind], near))))
        wanted = [m for m in re.finditer(pii.SSN, text) if m[0][:3] != "000" and re.search(pii.CONTEXT["ssn"], text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 40])]
        assert [(s.start, s.end) for s in r.found if s.kind == "ssn"] == [m.span() for m in wanted]
        out, at = [], 0
        for s in sorted((s for s in r.found if s.score >= 0.5), key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= at:
                out += [text[at : s.start], f"<{s.kind}>"]
            at = max(at, s.end)
        assert pii.mask(df.where(f"doc_id = {r.doc_id}")).first().text == "".join(out) + text[at:]


def test_language(spark, messy, empty):
    learned = language_id.learn(messy)
    assert set(learned) == {"en", "xx"} and all(len(d) <= language_id.DICTIONARY_BYTES for d in learned.values())
    out = language_id.identify(messy, learned).collect()
    model = language_id.Classifier(learned)
    by = collections.defaultdict(list)
    for i, t in texts(messy):
        by[i].append(model.best(t))
    assert len(out) == messy.count() and all((r.lang_pred, r.score, r.rejected) in by[r.doc_id] and 0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {60, 61, 62, 63, 302}
    kept = language_id.accepted(messy, learned)
    assert kept.columns == messy.columns and kept.count() == sum(not r.rejected for r in out)
    assert language_id.learn(empty) == {} and language_id.identify(empty, {}).collect() == []
    assert language_id.identify(messy, {}).where("lang_pred <> 'und'").count() == 0


def test_language_accuracy():
    de = "der die das und nicht mit einer sich auch wird heute morgen schreiben wir lange worte über den großen fluss " * 20
    fr = "les des une dans est pour que avec nous sommes allés vers la rivière où il y avait beaucoup de monde hier " * 20
    model = language_id.Classifier({"de": de.encode(), "fr": fr.encode()})
    assert model.best("wir schreiben heute nicht mit der langen feder")[0] == "de"
    assert model.best("nous avons vu beaucoup de monde pour la rivière")[0] == "fr"
    assert model.best("x")[2]


def brute_links(docs, n=5, threshold=0.8):
    def grams(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [(i, grams(t)) for i, t in docs]
    links, root = [0] * len(sets), list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and len(x & y) >= threshold * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[top(k)].append(i)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(i, low[top(k)], links[k]) for k, (i, _) in enumerate(sets)]


def test_jaccard_join(messy, empty):
    out = ngram_join.jaccard_join(messy)
    assert bag((r.doc_id, r.class_id, r.n_links) for r in out.collect()) == bag(brute_links(texts(messy)))
    assert ngram_join.jaccard_join(empty).collect() == []


def test_jaccard_join_in_many_chunks(spark, monkeypatch):
    """A group that is dealt over several chunks loses no link."""
    import random

    r = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(40):
        w = list(base)
        w[r.randrange(60)] = f"x{r.randrange(9)}"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "CHUNK", 2000)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = ngram_join.jaccard_join(df, recall=0.99999999).collect()
    assert bag((x.doc_id, x.class_id, x.n_links) for x in out) == bag(brute_links(docs))


def test_one_of_each(messy):
    kept = ngram_join.one_of_each(messy)
    classes = {c for _, c, _ in brute_links(texts(messy))}
    assert kept.columns == messy.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(c for c in classes if c is not None)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (100, 102)] + [(200, 200 + k) for k in range(1, 9)]
    out = {r.v: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(31)} | {k: 100 for k in (100, 101, 102)} | {200 + k: 200 for k in range(9)}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_banding(threshold):
    b, r = ngram_join.banding(threshold, 0.999)
    assert b * r <= 128 and 1 - (1 - threshold**r) ** b >= 0.999


def test_mixing(messy, empty):
    out = mixing.mix(messy).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(messy.repartition(5)).collect()), key=str)
    sizes = collections.Counter()
    for r in messy.select("text", "source").collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    goal = mixing.targets(list(sizes.items()), (5, 2, 1))
    assert math.isclose(sum(goal.values()), min(sum(sizes.values()), 3 * sum(sizes.values())), rel_tol=1e-9)
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], abs_tol=1e-9)
        assert r.taken == r.times * r.size and r.times <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
    assert mixing.mix(empty).collect() == []
    copies = mixing.take(messy)
    assert copies.columns == messy.columns and copies.count() == sum(r.times for r in out)


def test_targets():
    assert mixing.targets([("a", 10), ("b", 1000), (None, 10)], (5, 2, 1)) == {"a": 30.0, "b": 960.0, None: 30.0}
    assert mixing.targets([("a", 0)], (5,)) == {"a": 0.0}
    assert list(mixing.targets([("é", 1), ("z", 1), ("Z", 1)], (5, 2, 1), most=9)) == ["Z", "z", "é"]


def test_exact_dedup(messy, empty):
    out = exact_dedup.exact_dedup(messy).collect()
    groups = collections.defaultdict(list)
    for i, t in texts(messy):
        groups[t].append(i)
    wanted = collections.Counter()
    for i, t in texts(messy):
        keep = max((x for x in groups[t] if x is not None), default=None)
        wanted[i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert bag(out) == wanted
    assert exact_dedup.exact_dedup(empty).collect() == []
    kept = exact_dedup.drop_copies(messy)
    assert kept.columns == messy.columns and kept.count() == len(groups)


def test_exact_dedup_compares_bytes(messy):
    """With a hash that collides for all texts of one length, groups are still those of equal texts."""
    from pyspark.sql import functions as F

    weak = exact_dedup.exact_dedup(messy, hasher=lambda t: F.length(t) % 7).collect()
    assert bag(weak) == bag(exact_dedup.exact_dedup(messy).collect())


def test_audio(messy, empty):
    out = telephony.store_texts(messy)
    by = collections.defaultdict(list)
    for i, t in texts(messy):
        by[i].append(t.encode())
    for r in out.collect():
        for data in by[r.doc_id]:
            stored = data + b"\0" * (-len(data) % 64 or 64 * (not data))
            if len(data) == r.n_bytes:
                assert r.payload_sha256 == hashlib.sha256(stored).hexdigest() and r.payload_bytes == len(stored) and r.tail_crc32 == zlib.crc32(stored[-64:])
    media = telephony.media_of_texts(messy)
    files = collections.Counter()
    for r in media.collect():
        assert bytes(telephony.read_wave(bytes(r.media))[3])[: r.n_bytes] in by[r.doc_id]
        files[r.doc_id, hashlib.sha256(r.media).hexdigest(), len(r.media)] += 1
    assert bag((r.doc_id, r.media_sha256, r.media_bytes) for r in out.collect()) == files
    again = telephony.decode_audio(media, "doc_id", "media").collect()
    assert bag((r.doc_id, bytes(r.pcm)) for r in again) == bag((r.doc_id, bytes(r.pcm)) for r in out.collect())
    assert telephony.store_texts(empty).collect() == []


def test_codecs():
    # fixed values of the standards: silence and full scale
    assert telephony.MU[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    tone = (np.sin(np.arange(5000) / 15) * 9000).astype(np.int16)
    blocks = telephony.encode_adpcm(tone)
    back = telephony.decode_adpcm(blocks).reshape(-1)[:5000]
    assert np.sqrt(np.mean((back.astype(float) - tone) ** 2)) < 500
    one = telephony.decode_adpcm(blocks[3:4])  # a block does not depend on others
    assert np.array_equal(one[0], telephony.decode_adpcm(blocks)[3])
    assert np.array_equal(telephony.decode(telephony.wave(blocks.tobytes(), telephony.IMA_ADPCM, block=64))[0][:5000], back)
    assert np.array_equal(telephony.decode(telephony.wave(tone.astype("<i2").tobytes(), telephony.PCM))[0], tone)
    assert telephony.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    assert len(telephony.resample(tone, 8000, 11025)) == 5000 * 11025 // 8000
    with pytest.raises(ValueError):
        telephony.decode(b"RIFFxxxx")


def test_token_counts(spark, messy, empty):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["", " ", "  ", "   a", "a  b", "a   ", "▁", "a▁b ▁", "\n \n", "<s> </s><unk>", "é ﬁ 漢字　x\x00", "x" * 5000, "a b\tc"]
    df = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string").unionByName(messy.select("doc_id", "text"))
    wanted = collections.Counter((i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for i, t in texts(df))
    assert bag(token_counts.token_counts(df).collect()) == wanted
    assert token_counts.token_counts(empty).collect() == []


def test_pipeline_stages(spark, messy, empty, tmp_path):
    import corpus_pipeline

    docs = messy
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        if name != "best_fit_packing":
            assert docs.columns == messy.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in ("language_id", "exact_dedup", "ngram_jaccard_join"):
            assert docs.exceptAll(before).count() == 0
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_pii_ibans_end_at_their_countries_length(spark):
    ibans = ["AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "DE89370400440532013000", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "GB82-WEST-1234-5698-7654-32"]
    rows = [(f"{before}{x}{after}", len(before), x) for x in ibans for before in ("", "to 😀 ") for after in ("", " BIC RZBAATWW", " EUR 50", " 5002 12", ".")]
    df = pii.find_pii(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "doc_id int, text string"))
    for r in df.collect():
        found = [(x.start, x.end, x.match) for x in r.found if x.kind == "iban"]
        assert found == [(rows[r.doc_id][1], rows[r.doc_id][1] + len(rows[r.doc_id][2]), rows[r.doc_id][2])], rows[r.doc_id]
    wrong = spark.createDataFrame([(1, "AT61 1904 3002 3457 3202 BIC"), (2, "XAT61 1904 3002 3457 3201"), (3, "AT61 1904 3002 3457 3201A")], "doc_id int, text string")
    assert not [x for r in pii.find_pii(wrong).collect() for x in r.found if x.kind == "iban"]


def test_language_dictionaries_hold_more_than_the_texts_heads(spark):
    head, middle, tail = "licensed under these terms " * 3000, "palabra media " * 3000, "el final del texto " * 3000
    rows = [(k, head + middle + tail, "es") for k in range(20)] + [(k, "1234567890 " * 5000 + middle, "digits") for k in range(20, 40)]
    made = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(w in made["es"] for w in (b"licensed", b"palabra", b"el final del texto")) and b"palabra media" in made["digits"]
    assert all(len(d) <= language_id.DICTIONARY_BYTES for d in made.values())
    assert language_id.spread(b"abcdefghij", 10, 3) == b"abcdefghij" and language_id.spread(b"abcdefghijk", 8, 3) == b"ab ef jk"


def test_audio_has_a_shorter_last_block(spark):
    raw = np.random.default_rng(1).integers(0, 256, 64 * 3 + 20).astype(np.uint8)
    raw[2::64], raw[3::64] = 5, 0  # the headers' step index
    rest = lambda n: telephony.decode(telephony.wave(raw[: 64 * 3 + n].tobytes(), telephony.IMA_ADPCM, block=64))[0]
    assert len(rest(0)) == 3 * 121 and len(rest(4)) == 3 * 121 + 1 and len(rest(20)) == 3 * 121 + 33
    assert np.array_equal(rest(20)[-33:], telephony.decode_adpcm(raw[None, 192:])[0])
    files = [telephony.wave(raw[: 64 + n].tobytes(), telephony.IMA_ADPCM, block=64) for n in (0, 20, 3)] + [telephony.wave(bytes(n), telephony.PCM) for n in (6, 7)]
    df = telephony.decode_audio(spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "k int, m binary"), "k", "m")
    assert [(r.pcm is not None, r.error) for r in df.orderBy("k").collect()] == [(True, None), (True, None), (True, "3 bytes at the end are no sample"), (True, None), (True, "1 bytes at the end are no sample")]
