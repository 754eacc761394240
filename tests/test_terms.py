"""The terms behind a classifier's features, against plain counts."""

from collections import Counter

from pyspark.ml.feature import HashingTF

from plumbline.operators import models


def test_terms_are_looked_up_without_vectors_of_all_features(spark, monkeypatch):
    texts = ["safe lift  of the load", "Unsafe load under the crane", "the crane the crane", "", None, "é of ß", "safe safe walk"]
    df = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts * 3)], "doc_id int, text string, y int")
    model = models.text_classifier(df, features=1 << 6, chars=(3, 5))
    plain = Counter()
    for t in texts * 3:
        words = (t or "").lower().split(" ")
        own = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        plain.update(own + [f"~{f' {w} '[k : k + n]}" for w in words if w for n in (3, 4, 5) for k in range(len(w) + 3 - n)])
    plain.pop("", None)
    hashing = next(s for s in model.stages if isinstance(s, HashingTF))
    place = {t: hashing.indexOf(t) for t in plain}
    asked = [3, 17, 40]
    got = {(r.feature, r.term): r.uses for r in models.uses_of(model, df, asked).collect()}
    assert got == {(place[t], t): n for t, n in plain.items() if place[t] in asked} and got

    def dense(*_):
        raise AssertionError("a vector of all features for each term")

    monkeypatch.setattr(models, "vector_to_array", dense)
    weights = model.stages[-1].coefficients.toArray()
    best = sorted({k for k in place.values() if weights[k]}, key=lambda k: -weights[k])[:4]
    top = {r["rank"]: r for r in models.top_terms(model, df, top=4).where("side = 'positive'").collect()}
    for k, feature in enumerate(best, 1):
        own = sorted((-n, t) for t, n in plain.items() if place[t] == feature)
        assert (top[k].coefficient, top[k].n_terms, top[k].terms) == (weights[feature], len(own), [t for _, t in own[:5]])
    assert models.top_terms(model, df, top=1000).where("side = 'negative'").count() == len({k for k in place.values() if weights[k]})
