"""Language, toxicity and quality: held-out accuracy on the given tables, and small defined cases."""

from __future__ import annotations

import zlib

import numpy as np
from conftest_llm import by_id

from churnlens.llm import langid_ecoc, quality_gam, toxicity


def _remainder(i: int, modulus: int) -> int:
    return zlib.crc32(str(i).encode()) % modulus


def test_language_held_out(spark, medium):
    docs, _ = medium
    got = by_id(langid_ecoc.identify(docs, langid_ecoc.train(docs)))
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == langs.keys()
    held = [i for i, r in got.items() if r["held_out"]]
    assert set(held) == {i for i in langs if _remainder(i, 3) == 1}
    known = [i for i in held if langs[i] is not None]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in known]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_small_cases(medium, docs_of):
    docs, _ = medium
    model = langid_ecoc.train(docs)
    texts = [None, "", "123 456 ...", "word " * 50_000]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(3, texts[3], None, None)]
    got = langid_ecoc.identify(docs_of(rows), model).collect()
    assert len(got) == 5
    assert {r["lang_pred"] for r in got if r["doc_id"] < 3} == {"und"}
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 3}) == 1
    assert langid_ecoc.identify(docs_of([]), model).collect() == []


def test_ambiguous_texts(medium):
    docs, _ = medium
    model = langid_ecoc.train(docs)
    rows = [r for r in docs.collect() if r.lang is not None]
    long = {x: next(r.text for r in rows if r.lang == x and len(r.text) > 2500) for x in model.languages}
    langs, scores, unsure = langid_ecoc.predicted([r.text for r in rows], model)
    # few texts of the table are in doubt, and what is predicted without doubt is right
    assert sum(unsure) <= 0.03 * len(rows)
    assert all(a == r.lang for a, r, u in zip(langs, rows, unsure) if not u)
    first, second = [long[x] for x in model.languages[:2]]
    mixed = [first[:1200] + second[:1200], first[:1500] + second[:700], " ".join([first[:600], second[:600]] * 4)]
    foreign = ["zzz qqq", "xk qj zw vv kk jj ww qq " * 20, "Привет мир как дела сегодня " * 3, "日本語テキスト" * 9, "123 a", "x"]
    assert all(langid_ecoc.predicted(mixed + foreign, model)[2])
    assert not any(langid_ecoc.predicted([*long.values(), first[:200], second[:200]], model)[2])


def test_decoding_equals_a_plain_one(medium):
    docs, _ = medium
    model = langid_ecoc.train(docs)
    means = np.random.default_rng(2).normal(0, 0.3, (40, model.code.shape[1]))
    best, share, lead = model.decode(means)
    for k, row in enumerate(means):
        loss = [sum(w * np.log1p(np.exp(-c * (x * a + b))) for w, c, x, a, b in zip(model.weight, code, row, model.slope, model.shift))
                for code in model.code]
        order = sorted(range(len(loss)), key=loss.__getitem__)
        assert best[k] == order[0] and np.isclose(lead[k], loss[order[1]] - loss[order[0]])
        assert np.isclose(share[k], 1 / sum(np.exp(loss[order[0]] - x) for x in loss))


def test_parts_add_up_to_the_text(medium, monkeypatch):
    monkeypatch.setattr(langid_ecoc, "BYTES_AT_ONCE", 1000)
    columns = np.random.default_rng(1).normal(0, 1, (langid_ecoc.BUCKETS * len(langid_ecoc.GRAMS), 3)).astype(np.float32)
    texts = ["", None, "a", "ab", "abc def", "The quick brown fox " * 400, "é" * 700]
    means, size = langid_ecoc.bit_means(texts, columns)
    for k, text in enumerate(texts):
        raw = langid_ecoc._LOWER[np.frombuffer(f" {text or ''} ".encode(), np.uint8)]
        grams = np.concatenate(langid_ecoc.grams_of(raw))
        if len(raw) < 1000:
            assert size[k] == grams.size
        assert np.allclose(means[k], columns[grams].mean(0) if grams.size else 0.0, atol=1e-2)


def test_language_without_rows_to_learn_from(docs_of):
    model = langid_ecoc.train(docs_of([]))
    got = langid_ecoc.identify(docs_of([(1, "some words")]), model).collect()
    assert len(got) == 1 and 0 <= got[0]["score"] <= 1


def test_language_stage_keeps_texts_where_no_row_tells_a_language(spark, docs_of):
    import corpus_pipeline

    docs = docs_of([(1, "some words", None), (2, "andere Wörter", None), (3, "12 ...", None), (4, None, None)])
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_codewords_differ():
    for n in (2, 3, 6, 7, 20):
        code = langid_ecoc.codewords(n)
        assert code.shape[0] == n and len({tuple(x) for x in code.tolist()}) == n
        assert set(np.unique(code).tolist()) <= {-1, 1}


def _best_segment(gains: list[float]) -> float:
    """Largest sum of a run, by trying all runs."""
    return max((sum(gains[a:b]) for a in range(len(gains)) for b in range(a + 1, len(gains) + 1)), default=0.0)


def test_maximal_segments_against_all_runs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, drift = int(rng.integers(1, 14)), 0.5
        at = sorted(rng.choice(n, int(rng.integers(0, n + 1)), replace=False).tolist())
        gains = rng.integers(-2, 5, len(at)).astype(float).tolist()
        line = [-drift] * n
        for k, g in zip(at, gains):
            line[k] = g
        found = toxicity.maximal_segments(at, gains, drift)
        best = _best_segment(line)
        assert (max(s for *_, s in found) == best) if best > 0 else not found
        for a, b, s in found:
            assert abs(sum(line[a:b]) - s) < 1e-9
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_toxicity_held_out_and_small_cases(medium, docs_of):
    docs, labels = medium
    model = toxicity.train(docs, labels)
    got = by_id(toxicity.score(docs, model))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i, r in got.items() if r["held_out"] and toxic.get(i) is not None]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in got if _remainder(i, 5) == 0}
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    bad = next(r["text"] for r in docs.collect() if got[r["doc_id"]]["predicted"] == 1)
    rows = [(1, None), (2, ""), (3, bad), (3, bad), (4, "plain words here " * 20_000)]
    small = toxicity.score(docs_of(rows), model).collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in small) == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert all(r["passages"] for r in small if r["doc_id"] == 3)
    assert toxicity.score(docs_of([]), model).collect() == []


def test_toxicity_without_labels(docs_of, medium):
    _, labels = medium
    model = toxicity.train(docs_of([]), labels)
    assert [0 <= r["score"] <= 1 for r in toxicity.score(docs_of([(1, "a b")]), model).collect()] == [True]


def test_toxicity_of_words_in_few_labelled_documents(spark, docs_of):
    """No word stands out by itself: each toxic passage is in 8 labelled documents only."""
    rng = np.random.default_rng(11)
    rows, toxic = [], {}
    for i in range(800):
        text = [f"w{k}" for k in rng.integers(0, 60, 30)]
        toxic[i] = i % 2
        if toxic[i]:
            text[10:10] = [f"bad{i % 100}x{k}" for k in range(6)]
        rows.append((i, " ".join(text)))
    docs = docs_of(rows)
    model = toxicity.train(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    assert len(model.names) == 60 + 50 * 6  # every token of the sample, those against toxicity too
    got = by_id(toxicity.score(docs, model))
    assert np.mean([r["predicted"] == toxic[i] for i, r in got.items() if r["held_out"]]) > 0.9


def test_token_log_odds():
    n1, n0 = np.array([9.0, 0, 30, 1, 0]), np.array([0.0, 40, 30, 0, 1])
    odds = toxicity.log_odds(n1, n0, 500.0)
    assert odds[0] > odds[3] > 0 > odds[4] > odds[1]
    sides = np.array([2.0] * 50), np.array([18.0] * 50)  # tokens that fall to the sides by their size
    assert np.abs(toxicity.log_odds(*sides, 500.0)).max() < 1e-9
    assert toxicity.log_odds(np.zeros(0), np.zeros(0), 500.0).size == 0


def test_quality_held_out_and_small_cases(medium, docs_of):
    docs, labels = medium
    model = quality_gam.train(docs, labels)
    got = by_id(quality_gam.score(docs, model))
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i, r in got.items() if r["held_out"] and good.get(i) is not None]
    assert np.mean([got[i]["predicted"] == good[i] for i in held]) > 0.9
    rows = [(1, None), (2, ""), (3, "w " * 200_000), (3, "w " * 200_000), (4, " \n\t ")]
    small = quality_gam.score(docs_of(rows), model).collect()
    assert len(small) == 5 and all(0 <= r["score"] <= 1 for r in small)
    assert len({r["score"] for r in small if r["doc_id"] in (1, 2)}) == 1
    assert quality_gam.score(docs_of([]), model).collect() == []
    kept = quality_gam.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 1}


def test_quality_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair of the two tells
    model = quality_gam.fit(x, y, np.ones(600), rounds=20, pair_rounds=40)
    for row, margin in zip(x[:50], model.margin(x[:50])):
        want = model.start + sum(t[np.searchsorted(model.edges[j], row[j], side="right")]
                                 for j, t in enumerate(model.single))
        want += sum(t[np.searchsorted(model.pair_edges[j], row[j], side="right"),
                      np.searchsorted(model.pair_edges[k], row[k], side="right")] for j, k, t in model.pairs)
        assert abs(want - margin) < 1e-9
    assert np.mean((model.score(x) >= 0.5) == y) > 0.85


def _losses(margin, y):
    return np.mean(np.logaddexp(0, np.where(y > 0, -margin, margin)))


def test_boosting_learns_features_and_pairs():
    """A label that one feature tells in stretches, and one that only a pair of features tells."""
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    stretch = ((x[:, 0] > 0.3) & (x[:, 0] < 0.6)).astype(float)
    either = ((x[:, 1] > 0.5) != (x[:, 2] > 0.5)).astype(float)
    even = np.ones(len(x))
    one = quality_gam.fit(x[:2000], stretch[:2000], even[:2000])
    assert np.mean((one.score(x[2000:]) > 0.5) == stretch[2000:]) > 0.97
    two = quality_gam.fit(x[:2000], either[:2000], even[:2000])
    assert np.mean((two.score(x[2000:]) > 0.5) == either[2000:]) > 0.95 and two.pairs[0][:2] == (1, 2)
    alone = quality_gam.fit(x[:2000], either[:2000], even[:2000], pairs=0)
    assert np.mean((alone.score(x[2000:]) > 0.5) == either[2000:]) < 0.65
    # more rounds fit the sample better, and the start is the share of the label
    losses = [_losses(quality_gam.fit(x, stretch, even, rounds=k, pairs=0).margin(x), stretch) for k in (1, 10, 60)]
    assert losses[0] > losses[1] > losses[2]
    assert np.isclose(quality_gam.fit(x, stretch, even, rounds=0, pairs=0).score(x)[0], stretch.mean())


def test_a_shallow_tree_equals_trying_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(100):
        n, ridge = int(rng.integers(2, 9)), 0.7
        grad, hess = rng.normal(size=n), rng.random(n)
        got = quality_gam._shallow_tree(grad, hess, 2, ridge)
        value = lambda a, b: grad[a:b].sum() ** 2 / (hess[a:b].sum() + ridge)
        m = max(range(1, n), key=lambda k: value(0, k) + value(k, n))
        if value(0, m) + value(m, n) - value(0, n) < 1e-6:
            continue
        want = [grad[:m].sum() / (hess[:m].sum() + ridge)] * m + [grad[m:].sum() / (hess[m:].sum() + ridge)] * (n - m)
        assert np.allclose(got, want)
