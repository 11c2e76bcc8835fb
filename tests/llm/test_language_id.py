import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from odd import documents, empty, fold
from pyspark.sql import functions as F

from pickwell.llm import language_id as L
from pickwell.llm.queries import QUERIES

TEXTS = {"aa": ["Banana bandana, ban an ananas", "nab a banana"], "bb": ["zig zag zug", "zigzag gizmo zoo"], "cc": ["été élève", ""]}


def phrases(symbols, known):
    """Fewest phrases that occur in the training symbols; an unknown symbol is a phrase."""
    total, begin = 1, 0
    for i in range(len(symbols)):
        if symbols[begin : i + 1] not in known:
            begin = i
            total += 1
            if symbols[i : i + 1] not in known:
                begin = i + 1
                total += 1
    return total


@pytest.mark.parametrize("window", [1, 3, L.WINDOW])
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.text("banzigé -A", max_size=60), st.text(max_size=20)), max_size=8))
def test_phrases_against_brute_force(monkeypatch, window, texts):
    monkeypatch.setattr(L, "WINDOW", window)
    languages = L.Languages(TEXTS)
    bits, lettered = languages.entropies(texts)
    for j, name in enumerate(languages.names):
        train = b"".join(languages.symbols([t])[0].tobytes() for t in TEXTS[name]).replace(b"\0", b"")
        known = {train[a:b] for a in range(len(train)) for b in range(a + 1, len(train) + 1)}
        for i, text in enumerate(texts):
            symbols = languages.symbols([text])[0].tobytes()
            assert np.isclose(bits[i, j], phrases(symbols, known) * np.log2(max(2, len(train))) / max(1, len(symbols)))
    assert lettered.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_every_letter_of_the_training_text_counts():
    han = [chr(0x4E00 + i) for i in range(3_000)]
    texts = {
        "aa": ["banana bandana"],
        "yy": ["".join(han[:1_500]), "".join(han[1_000:0:-1])],
        "zz": ["".join(han[:200]), "".join(han[1_400:])],
    }
    languages = L.Languages(texts)
    assert languages.width == 3_000 + 2 + len(set("bandana")) and languages.width > L.WIDTH
    asked = ["".join(han[2_500:2_700]), "".join(han[900:1_000]), "".join(han[700:600:-1]), "".join(han[1_450:1_600]), "banana"]
    assert languages.predict(asked)[0] == ["zz", "yy", "yy", "zz", "aa"]
    bits, _ = languages.entropies(asked)
    for j, name in enumerate(languages.names):
        train = np.concatenate([languages.symbols([t])[0] for t in texts[name]]).tolist()
        text = "".join(map(chr, train))
        known = {text[a:b] for a in range(len(text)) for b in range(a + 1, min(len(text), a + 200) + 1)}
        for i, t in enumerate(asked):
            symbols = "".join(map(chr, languages.symbols([t])[0].tolist()))
            assert np.isclose(bits[i, j], phrases(symbols, known) * np.log2(len(train)) / len(symbols))


def test_long_texts_are_parsed_whole():
    languages = L.Languages(TEXTS)
    assert languages.predict(["zig zag " * 20_000 + "banana", "banana " * 20_000, "", "banana"])[0] == ["bb", "aa", "und", "aa"]
    assert languages.entropies(["zig zag " * 20_000])[0][0, 1] < 1


def test_predictions_of_odd_rows(spark):
    docs = documents(spark, ["banana", None, "", "123 !?", "zigzag", "ωω", "banana"], [1, 2, 3, 4, None, 6, 1])
    rows = sorted(map(str, ((r.doc_id, r.lang_pred) for r in L.predict(docs, TEXTS).collect())))
    assert rows == sorted(map(str, [(1, "aa"), (2, "und"), (3, "und"), (4, "und"), (None, "bb"), (6, "cc"), (1, "aa")]))
    assert all(0 <= r.score <= 1 for r in L.predict(docs, TEXTS).collect())
    assert {r.lang_pred for r in L.predict(docs, {}).collect()} == {"und"}
    assert {r.score for r in L.predict(docs, {"aa": TEXTS["aa"]}).collect()} == {0.0, 1.0}
    assert L.predict(empty(spark), TEXTS).count() == 0


class Within:
    """What occurs in a text, without listing it."""

    def __init__(self, text):
        self.text = text

    def __contains__(self, part):
        return part in self.text


def test_phrases_go_on_over_the_ends_of_windows():
    texts = {"aa": "ab" * 3_000, "bb": "ba" * 40}
    languages = L.Languages({name: [text] for name, text in texts.items()})
    text = "ab" * 2_900
    symbols = languages.symbols([text])[0].tobytes().decode("latin-1")
    bits, _ = languages.entropies([text])
    for j, name in enumerate(languages.names):
        train = Within(languages.symbols([texts[name]])[0].tobytes().decode("latin-1"))
        assert np.isclose(bits[0, j], phrases(symbols, train) * languages.bits[j] / len(symbols))


def test_training_sample_is_bounded_and_keeps_to_its_rows(spark):
    docs = documents(spark, [f"{'abc'[i % 3] * 5_000} {i}" for i in range(200)] + [None, "b"]).withColumn(
        "lang", F.when(F.col("doc_id") == 201, None).when(F.col("doc_id") % 3 == 0, "x").otherwise("y")
    )
    texts = L.training_texts(docs, F.col("doc_id") != 1)
    assert set(texts) == {"x", "y"} and all(len(t) == L.SAMPLE_ROWS for t in texts.values())
    assert all(len(t) > 5_000 and not t.endswith(" 1") for ts in texts.values() for t in ts)
    assert L.training_texts(empty(spark), F.lit(True)) == {}


def test_training_sample_is_of_distinct_whole_texts_with_letters(spark):
    own = [f"{'ab'[i % 2] * (i + 1)} words" for i in range(20)]
    long = ["z" * (3_000 + i) for i in range(50)]
    docs = documents(spark, ["copy"] * 500 + [""] * 200 + ["12 !"] * 200 + own + long).withColumn("lang", F.lit("x"))
    texts = L.training_texts(docs, F.lit(True))["x"]
    assert sorted(texts) == sorted(["copy", *own, *long[: L.SAMPLE_ROWS - 21]])


def test_query_on_held_out_rows(spark):
    rows = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97
