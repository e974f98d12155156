import pytest
from pyspark.sql import functions as F

from procmatch.functions import extract, querytext, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column).first()[0]


def test_tokens(spark):
    got = one(spark, "50W LED Street Light for Municipal Roads!", text.tokenize(F.col("t")))
    assert got == ["50w", "led", "street", "light", "municipal", "roads"]
    assert one(spark, None, text.tokenize(F.col("t"))) == []
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 78 and len(text.HINDI_TERMS) == 26


def test_cleaning(spark):
    got = one(spark, "   50W   LED   street   light  \r\n\r\n\n\nOperating Voltage: 240V   AC\nIS 10322   ", text.clean_extracted(F.col("t")))
    assert got == "50W LED street light\n\nOperating Voltage: 240V AC\nIS 10322"
    assert one(spark, None, text.clean_extracted(F.col("t"))) == ""


def test_hindi_expansion(spark):
    q = "कृषि के लिए सबमर्सिबल पानी का पंप"
    got = one(spark, q, text.expand_query(F.col("t")))
    assert got == q + " agriculture agricultural farming water pump pumpset submersible"
    assert one(spark, "  ", text.expand_query(F.col("t"))) == "  " and one(spark, " x ", text.expand_query(F.col("t"))) == "x"


def test_empty_record_has_no_embedding_text(spark):
    row = spark.createDataFrame([("", "", "", "", [], "", None)], "is_number string, title string, product_category string, sector string, keywords array<string>, scope string, description string")
    assert row.select(text.embedding_content()).first()[0] == ""


def test_normalized_values(spark):
    assert one(spark, [" a ", "b"], text.normalize_value(F.col("t"), "array<string>"), "array<string>") == ["a", "b"]
    assert [tuple(e) for e in one(spark, {"b": " 1", "a": "2 "}, text.normalize_map(F.col("t")), "map<string,string>")] == [("a", "2"), ("b", "1")]
    assert one(spark, 800.0, text.sigmoid(F.col("t")), "double") == 1.0 and one(spark, -800.0, text.sigmoid(F.col("t")), "double") == 0.0


TRANSFORMER = "Supply of 100 kVA 11 kV/433 V distribution transformer, 50 Hz, 98% efficiency as per IS 1180 (Part 1) : 2014 and IS 2062."


def test_attributes(spark):
    got = [tuple(a) for a in one(spark, TRANSFORMER, extract.technical_attributes(F.col("t")))]
    assert [(a, v, u) for a, v, u, _ in got] == [("capacity", "100", "kVA"), ("voltage", "11", "kV"), ("voltage", "433", "V"), ("frequency", "50", "Hz"), ("efficiency", "98", "%")]
    led = [tuple(a)[:3] for a in one(spark, "IP 66 luminaire 50W, 240 V, surge 10 kV surge, 85 percent, ip66", extract.technical_attributes(F.col("t")))]
    assert led == [("ingress_protection", "IP66", None), ("ingress_protection", "IP66", None), ("capacity", "50", "W"), ("voltage", "240", "V"), ("voltage", "10", "kV"), ("efficiency", "85", "%"), ("surge_protection", "10", "kV")]


def test_mentions(spark):
    assert one(spark, TRANSFORMER + " is 2062", extract.is_mentions(F.col("t"))) == ["IS 1180 (Part 1) : 2014", "IS 2062"]
    assert one(spark, "IS 1180 (Part 1) and", extract.is_mentions(F.col("t"))) == ["IS 1180"]


@pytest.mark.parametrize(("value", "want"), [("An oil immersed Transformer", ("Oil Immersed Transformer", "Transformers")), ("new led street light", ("Street Light", "Lighting & Luminaires")), ("--- Page 1 ---\n Desks \n", ("Desks", None)), ("x" * 120, (None, None))])
def test_product(spark, value, want):
    assert tuple(one(spark, value, extract.product(F.col("t")))) == want


def test_requirements(spark):
    docs = spark.createDataFrame([(1, TRANSFORMER), (2, " \n"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["requirements"] for r in extract.extract_requirements(docs).collect()}
    assert got[1]["product"]["category"] == "Transformers" and "transformer" in got[1]["keywords"]
    for k in (2, 3):
        assert got[k]["product"]["name"] is None and got[k]["technical_requirements"] == [] and got[k]["keywords"] == []
    r = F.col("requirements")
    row = extract.extract_requirements(docs.where("doc_id = 1")).select(querytext.keyword_query(r), querytext.semantic_query(r), querytext.display_query(r)).first()
    assert "100 kVA 100kVA" in row[0] and row[1].startswith("Technical specification for Distribution Transformer in category Transformers.") and row[2] == "Distribution Transformer (100kVA, 11kV, 433V)"
    none = extract.extract_requirements(docs.where("doc_id = 3")).select(querytext.keyword_query(r), querytext.semantic_query(r), querytext.display_query(r)).first()
    assert list(none) == [querytext.NO_QUERY, querytext.NO_QUERY, querytext.NO_DISPLAY]


def test_clauses(spark):
    lines = "\n".join([f"Fire safety {i}" for i in range(7)] + ["Outdoor pole", "x" * 400 + " fire"])
    assert one(spark, lines, extract.safety_clauses(F.col("t"))) == [f"Fire safety {i}" for i in range(5)]
    assert one(spark, lines, extract.installation_clauses(F.col("t"))) == ["Outdoor pole"]
