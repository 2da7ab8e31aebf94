import random

from surveyloom.llm import toxicity


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))


def test_quota_is_even_and_keeps_the_bound():
    assert toxicity.even_quota([3, 5, 9], 17) == 9
    assert toxicity.even_quota([3, 5, 9], 11) == 4
    assert toxicity.even_quota([2, 100, 100], 12) == 5
    assert toxicity.even_quota([], 4) == 0


def test_long_texts_leave_room_for_all_others(spark, monkeypatch):
    """One very long ordinary text does not fill the ordinary dictionary, and no more windows than asked reach the driver."""
    rng = random.Random(4)
    rows = [(i, words(rng, "klmnop", 60), i % 4 == 1) for i in range(80)]
    rows = [(i, t if not toxic else t + " " + "vilest wretched scoundrel " * 3, int(toxic)) for i, t, toxic in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    chosen = toxicity.training_texts(docs, labels, "toxic", 3000, 5000, 11)
    first = chosen.where("label = 0").orderBy("first", "second").first()["second"]
    long = words(rng, "abcdef", 40_000)
    docs = spark.createDataFrame([(i, long if i == first else t) for i, t, _ in rows], "doc_id long, text string")
    samples, plain = [], toxicity._dictionary
    monkeypatch.setattr(toxicity, "_dictionary", lambda parts, size, **how: samples.append(parts) or plain(parts, size, **how))
    toxicity.toxicity_model(docs, labels, max_windows=400)
    others = sum(not set(w.decode()) & set("abcdef") for w in samples[0])
    assert len(samples[0]) <= 400 and others >= 100 and len(samples[0]) - others >= 100
