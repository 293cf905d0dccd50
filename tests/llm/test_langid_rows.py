import numpy as np
import pyarrow as pa

from touchline.llm import langid
from touchline.llm.textcore import chunks


def shape(texts):
    return np.concatenate([langid.histograms(d, o) for _, _, d, o in chunks(pa.array(texts))])


def test_texts_do_not_depend_on_their_neighbours():
    texts = ["ja", "das Haus", "", "x", "the house", "é"]
    assert np.allclose(shape(texts), np.concatenate([shape([t]) for t in texts]))


def test_the_fit_takes_languages_in_turn(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 4)
    monkeypatch.setattr(langid, "LANGS", 2)
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append(sorted(zip(langs, texts))))
    rows = [(k, f"text {k}", f"l{k % 4}") for k in range(200)]
    for parts in (1, 7):
        langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts))
    assert seen[0] == seen[1] and [x for x, _ in seen[0]] == [f"l{k}" for k in range(4) for _ in range(2)]
