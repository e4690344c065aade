"""Quality, language and toxicity: slow forward passes, numeric gradients, held-out results, odd tables, and their stages."""

import math
import zlib

import numpy as np
import pytest

from cityjobs.llm import langid, quality, toxicity
from cityjobs.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in is that for with was on are this from have they which one were all".split(),
    "de": "der die und das ist nicht mit ein auch sich auf für werden eine dem wird sind von bei zu".split(),
}


@pytest.fixture(scope="module")
def rows():
    """600 documents in two languages: odd ids are good, a seventh is toxic."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(600):
        lang = "en" if i % 3 else "de"
        words = list(rng.choice(WORDS[lang], int(rng.integers(20, 120))))
        if i % 2 == 0:
            words = [w.upper() + "!!!" if k % 3 == 0 else w for k, w in enumerate(words)]
        if i % 7 == 0:
            for bad in ("scoundrel", "nitwit", "vermin")[: int(rng.integers(1, 4))]:
                words.insert(int(rng.integers(0, len(words))), bad)
        out.append((i, " ".join(words), lang, "s", 0))
    return out


@pytest.fixture(scope="module")
def odd(rows):
    more = [(9000, None, None, None, None), (9001, "", "en", None, 0), (None, rows[1][1], "en", None, 3), (1, rows[1][1], "en", "s", 0), (9002, "12 34 \n 5", "en", "x", 1), (9003, rows[3][1] * 200, "en", "x", 1)]
    return rows + more


@pytest.fixture(scope="module")
def tables(spark, odd):
    prepare(spark)
    docs = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "'x' as score", "7 as y", "'p' as predicted", "1 as _row", "2 as i")
    labels = spark.createDataFrame([(i, int(i % 2 == 1), int(i % 7 == 0)) for i in range(600)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def held(doc_id, fold):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % fold


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    return (rank[label == 1].mean() - (label.sum() - 1) / 2) / (label == 0).sum()


# quality


def slow_logit(m, index, value):
    total = m.bias + sum(m.weight[i] * x for i, x in zip(index, value))
    for a in range(len(index)):
        for b in range(a):
            total += (m.factor[index[a]] @ m.factor[index[b]]) * value[a] * value[b]
    return total


def test_quality_logits_are_all_pairs_of_features():
    rng = np.random.default_rng(2)
    found = [quality.features(t.encode(), [("n", 12), ("kind", None)]) for t in ("One TWO, two three!", "", "a\nb\nc (d) " * 9)]
    rows = quality.Rows.of(found)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 8)), np.zeros(quality.STATS), np.ones(quality.STATS))
    scaled = m.scaled(rows)
    for r, z in enumerate(m.logits(rows)):
        span = slice(scaled.at[r], scaled.at[r + 1])
        assert z == pytest.approx(slow_logit(m, scaled.index[span], scaled.value[span]), rel=1e-5)
    assert list(rows.take(np.array([2, 0])).index[: len(found[2][0])]) == list(found[2][0])
    assert quality.level(1000) == 9 and quality.level(-1000) == -9 and quality.level(None) is None and quality.level(float("inf")) > 900


def test_quality_gradients_are_numeric_ones():
    rng = np.random.default_rng(3)
    rows = quality.Rows.of([quality.features(t) for t in (b"good plain text here.", b"BUY now!!! now", b"")])
    m = quality.Machine(0.1, rng.normal(0, 0.3, quality.SIZE), rng.normal(0, 0.3, (quality.SIZE, 8)), np.zeros(quality.STATS), np.ones(quality.STATS))
    rows, y, weigh = m.scaled(rows), np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])

    def loss():
        p = quality.sigmoid(m.forward(rows)[0])
        return -(weigh * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    met, gw, gv, gb = m.gradients(rows, y, weigh)
    for k in (0, len(met) // 2, len(met) - 1):
        for array, at, want in ((m.weight, met[k], gw[k]), (m.factor, (met[k], 3), gv[k, 3])):
            old, step = array[at], 1e-5
            array[at] = old + step
            up = loss()
            array[at] = old - step
            down = loss()
            array[at] = old
            assert (up - down) / (2 * step) == pytest.approx(want, rel=1e-3, abs=1e-6)
    old = m.bias
    m.bias = old + 1e-5
    up = loss()
    m.bias = old - 1e-5
    assert (up - loss()) / 2e-5 == pytest.approx(gb, rel=1e-3)


def test_quality_interactions_learn_what_no_single_word_tells():
    rng = np.random.default_rng(5)
    texts, y = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join(rng.permutation([*(["alpha"] if a else ["gamma"]), *(["beta"] if b else ["delta"])])).encode())
        y.append(float(a != b))
    rows, y = quality.Rows.of([quality.features(t) for t in texts]), np.array(y)
    use, rest = rows.take(np.arange(900)), rows.take(np.arange(900, 1200))
    assert auc(quality.fit(use, y[:900], 0.5, epochs=40, rate=0.3).logits(rest), y[900:]) > 0.95
    assert auc(quality.fit(use, y[:900], 0.5, epochs=40, rate=0.3, factors=0).logits(rest), y[900:]) < 0.7


def test_quality_of_held_out_documents_and_odd_rows(spark, tables, odd):
    docs, labels = tables
    got = quality.scored(docs, labels, metadata=("n_chars",)).collect()
    assert len(got) == len(odd)
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert auc(np.array([r["score"] for r in out]), np.array([r["doc_id"] % 2 for r in out])) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert {round(r["score"], 6) for r in quality.scored(docs, labels.limit(0)).collect()} == {0.3}


def test_quality_stage_keeps_rows_and_columns(spark, tables, odd):
    docs, labels = tables
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    score = {(r["doc_id"]): r["predicted"] for r in quality.scored(docs, labels, held=-1).collect()}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) != []
    good = [r["doc_id"] for r in kept.collect()]
    assert good.count(1) == 2 and None in good
    labelled = [i for i in good if i is not None and i < 600]
    assert sum(i % 2 for i in labelled) > 0.95 * len(labelled) and len(set(labelled)) > 280
    assert set(good) - {None} <= set(score)
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == len(odd)
    one_class = quality.keep_good(docs, labels.where("quality = 1")).count()
    assert one_class == len(odd)


# language


def test_language_forward_and_gradients():
    rng = np.random.default_rng(7)
    text = "Der Weg zum See ".encode() * 3
    index, counts = langid.counted(text)
    every = np.concatenate(list(langid.buckets(text)))
    assert counts.sum() == len(every) == 2 * (len(text) + 1) and list(np.unique(every)) == list(index)
    embed, linear, bias = rng.normal(size=(langid.BUCKETS, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    model = langid.Model(["a", "b", "c"], (embed @ linear).astype(np.float32), bias)
    slow = sum(embed[b] for b in every) / counts.sum() @ linear + bias
    assert model.logits(text) == pytest.approx(slow, rel=1e-4)
    x = counts / counts.sum()

    def loss():
        return -math.log(langid.softmax((x @ embed[index]) @ linear + bias)[1])

    of_embed, of_linear, of_bias = langid.step(x, index, 1, embed, linear, bias)
    for array, at, want in ((embed, (index[2], 1), of_embed[2, 1]), (linear, (2, 0), of_linear[2, 0]), (bias, 2, of_bias[2])):
        old = array[at]
        array[at] = old + 1e-5
        up = loss()
        array[at] = old - 1e-5
        down = loss()
        array[at] = old
        assert (up - down) / 2e-5 == pytest.approx(want, rel=1e-3, abs=1e-7)


def test_long_texts_are_counted_whole(monkeypatch):
    text = b"some words and some more of them " * 40
    whole = langid.counted(text)
    monkeypatch.setattr(langid, "PIECE", 256)
    cut = langid.counted(text)
    assert len(list(langid.buckets(text))) > 4 and all(np.array_equal(x, y) for x, y in zip(whole, cut))


def test_letters_are_those_of_category_l():
    rows = [langid.counted(t.encode()) for t in ("the cat and the dog", "der Hund und die Katze")]
    model = langid.fit([*rows] * 3, ["en", "de"] * 3)
    for text in ("½", "²³", "①", "Ⅷ", "12 _", "", "̈", "😀"):
        assert model.predict(text.encode()) == ("und", 0.0), text
    for text in ("a", "ß", "ª", "я", "字", "ʰ", "1a"):
        assert model.predict(text.encode())[0] in ("de", "en"), text


def test_language_of_held_out_documents_and_odd_rows(spark, tables, odd):
    docs, _ = tables
    got = langid.identified(docs).collect()
    assert len(got) == len(odd)
    lang = {i: x for i, _, x, _, _ in odd}
    out = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.98
    assert all(r["held_out"] == (held(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (9000, 9001, 9002)} == {"und"}
    assert langid.identified(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identified(docs.withColumn("lang", docs.lang.substr(9, 1).cast("string")).where("doc_id < 9")).collect()} <= {"", "und"}
    assert {r["lang_pred"] for r in langid.identified(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    one = langid.identified(docs.where("lang = 'en'")).collect()
    assert {r["lang_pred"] for r in one} == {"en", "und"}


def test_rare_languages_are_learned(spark, rows):
    docs = spark.createDataFrame([(10_000 + i, f"ka lo mi {i} na pu ka mi lo", "xx", "s", 0) for i in range(30)] + rows * 2, SCHEMA)
    model = langid.train(docs, bound=120)
    assert model.names == ["de", "en", "xx"]
    assert model.predict(b"mi na pu ka lo lo mi")[0] == "xx" and model.predict(b"the one that was from all of this")[0] == "en"


def test_language_stage_keeps_rows_and_columns(spark, tables, odd):
    docs, _ = tables
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 2 and None in ids and not {9000, 9001, 9002} & set(ids)
    assert len(ids) >= 0.98 * len(odd)
    assert langid.keep_known(docs.limit(0)).count() == 0
    assert langid.keep_known(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).count() == 0


# toxicity


def slow_toxic(net, text):
    words = [w.strip(toxicity.EDGE) for w in text.lower().split()]
    vectors = [np.zeros(toxicity.DIM)]
    for w in words:
        vectors.append(sum(net.embed[net.row[zlib.crc32(w[:n], k) % toxicity.BUCKETS]] for k, n in enumerate(toxicity.PARTS)))
    vectors += [np.zeros(toxicity.DIM)] * 2
    z, column = net.bias, 0
    for filters in net.filters:
        for f in range(toxicity.FILTERS):
            best = max(sum(vectors[i + k] @ filters[k][:, f] for k in range(len(filters))) for i in range(len(words) + 1))
            z += max(0, best + net.offset[column]) * net.out[column]
            column += 1
    return z


def test_toxicity_forward_and_gradients(monkeypatch):
    texts = [b"You are a scoundrel and a nitwit, truly", b"", b"the one that was from all of this", b"one two"] * 3
    ids = [toxicity.word_ids(t) for t in texts]
    net = toxicity.untrained(ids, 4)
    net.offset += np.random.default_rng(1).normal(0, 0.1, toxicity.OUT)
    for t in texts:
        assert net.logit(t) == pytest.approx(slow_toxic(net, t), rel=1e-4)
    whole = net.logit(b" ".join(texts))
    monkeypatch.setattr(toxicity, "PIECE", 3)
    assert net.logit(b" ".join(texts)) == pytest.approx(whole, rel=1e-5)
    net.embed, net.filters = net.embed.astype(float), [f.astype(float) for f in net.filters]
    rows, y, weigh = [net.rows(x) for x in ids], np.array([1.0, 0, 0, 1] * 3), np.linspace(0.5, 2, 12)

    def loss():
        p = quality.sigmoid(np.array([np.maximum(net.pooled(r)[0], 0) @ net.out + net.bias for r in rows]))
        return -(weigh * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    (met, of_embed), of_filters, of_offset, of_out, of_bias = net.gradients(rows, y, weigh)
    some = int(np.abs(of_embed).sum(1).argmax())
    for array, at, want in ((net.embed, (met[some], 2), of_embed[some, 2]), (net.filters[2], (1, 3, 5), of_filters[2][1, 3, 5]), (net.filters[0], (0, 2, 2), of_filters[0][0, 2, 2]), (net.offset, 4, of_offset[4]), (net.out, 9, of_out[9])):
        old = array[at]
        array[at] = old + 1e-3
        up = loss()
        array[at] = old - 1e-3
        down = loss()
        array[at] = old
        assert (up - down) / 2e-3 == pytest.approx(want, rel=0.1, abs=2e-4)  # the maxima are in single precision


def test_only_trained_weights_tell_toxic_texts(rows):
    texts, y = [t.encode() for _, t, *_ in rows], np.array([float(i % 7 == 0) for i, *_ in rows])
    train = np.arange(600) % 3 != 1
    used = [t for t, x in zip(texts, train) if x]
    before = toxicity.untrained([toxicity.word_ids(t) for t in used])
    after = toxicity.fit(used, y[train], ["en"] * len(used))
    scores = [np.array([net.logit(t) for t, x in zip(texts, train) if not x]) for net in (before, after)]
    assert 0.25 < auc(scores[0], y[~train]) < 0.75
    assert auc(scores[1], y[~train]) > 0.95
    found = scores[1] >= after.cuts.get("en", after.cuts[""])
    assert found[y[~train] == 1].mean() > 0.9 and found[y[~train] == 0].mean() < 0.05


def test_toxicity_of_held_out_documents_and_odd_rows(spark, tables, odd):
    docs, labels = tables
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(odd)
    assert all(r["held_out"] == (held(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    label = np.array([int(r["doc_id"] % 7 == 0) for r in out])
    assert auc(np.array([r["score"] for r in out]), label) > 0.95
    assert np.mean([r["predicted"] for r, y in zip(out, label) if y]) > 0.85
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert toxicity.scored(docs, labels.where("toxic = 0")).count() == len(odd)
    assert toxicity.scored(docs, labels.limit(0)).count() == len(odd)
