import numpy as np
from pyspark.sql import functions as F

from chronoframe.llm import langid, queries
from llm_paths import DATA


def test_held_out_accuracy(spark):
    out = queries.op2_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held >= 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def parse(sample, text):
    """Phrases of greedy longest matches."""
    i = n = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i:i + k + 1] in sample:
            k += 1
        i, n = i + k, n + 1
    return n


def test_phrases_against_substring_search():
    rng = np.random.default_rng(3)
    draw = lambda n, letters: "".join(rng.choice(list(letters), n))
    samples = {"aa": draw(300, "abcd "), "bb": draw(300, "cdef ")}
    m = langid.Model({k: [v] for k, v in samples.items()})
    texts = [draw(int(n), "abcdefxyz ") for n in rng.integers(1, 400, 40)]
    total, n, letters = m.phrases(texts)
    assert n.tolist() == [len(t) for t in texts]
    # all letters that no sample holds are one symbol, which no sample has either
    for j, lang in enumerate(m.langs):
        for i, t in enumerate(texts):
            if letters[i]:
                assert total[j, i] == parse(samples[lang], t)


def test_edges(messy, nothing):
    model = langid.train(messy)
    assert model.langs == ["de", "en", "es", "fr"]
    got = langid.identify(messy, model, ["doc_id", "text"]).collect()
    assert len(got) == messy.count()
    for r in got:
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == none and (r.score == 0) == none
    kept = langid.identified(messy, model)
    assert kept.columns == messy.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    assert langid.identify(nothing, model, ["doc_id"]).collect() == []
    empty = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(messy, empty, ["doc_id"]).collect()} == {"und"}


def test_every_label_is_learned(spark):
    """200 languages of five letters each, of scripts with thousands of letters."""
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rows = []
    for lang in range(200):
        own = letters[lang * 15:lang * 15 + 15]
        for d in range(6):
            rows.append((lang * 10 + d, "".join(rng.choice(own, 120)), f"l{lang:03d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 10 < 5"))
    assert len(model.langs) == 200 and model.alphabet.digits == 2 and model.alphabet.width <= langid.WIDEST
    out = langid.identify(df, model, ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang for r in out)


def test_sample_is_slices_of_many_documents(spark):
    """One very long document is no more of the sample than any other."""
    rows = [(0, "q" * 200_000, "a")] + [(i, f"{chr(97 + i % 16)}" * 3000, "a") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_sample(df, 50, 10_000, 10 ** 6, "doc_id", "text", "lang")["a"]
    assert len(got) == 50 and {len(t) for t in got} == {200}
    assert langid.training_sample(df, 50, 10_000, 600, "doc_id", "text", "lang")["a"][0] in {t[:12] for t in got}


def test_whole_predictions_against_brute_force(spark):
    """Labels, scores and rates of the query's model, by plain substring search."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = langid.training_sample(docs.where(queries.remainder(5) != 0), 20, 3000, 10 ** 6, "doc_id", "text", "lang")
    model = langid.Model(texts)
    sample = {k: model.alphabet.symbols("\n".join(texts[k])).tobytes() for k in model.langs}
    rows = docs.where("length(text) < 5000").orderBy("doc_id").limit(60).collect()
    label, score, rate = model.predict([r.text or "" for r in rows])
    for r, got, s, x in zip(rows, label, score, rate):
        digits = model.alphabet.symbols(r.text or "").tobytes()
        if not any(digits):
            assert got == "und"
            continue
        cut = langid.BLOCK * model.alphabet.digits
        counts = {k: sum(parse(sample[k], digits[i:i + cut]) for i in range(0, len(digits), cut)) for k in model.langs}
        assert got == min(counts, key=lambda k: (counts[k], k))
        assert abs(s - (1 / min(counts.values())) / sum(1 / c for c in counts.values())) < 1e-12
        assert abs(x - min(counts.values()) / len(r.text)) < 1e-12
