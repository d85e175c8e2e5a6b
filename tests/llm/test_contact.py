import pytest
from pyspark.sql import functions as F

from treeloom.llm import contact
from treeloom.llm.extid import content, ext_id_texts

EMAILS = {
    "a.b@x.example": "a.b@x.example",
    "  A.B+News@X.Example\t\r\n": "a.b@x.example",
    "mailto:a.b@x.example": "a.b@x.example",
    "Ann Lee <a.b@x.example>": "a.b@x.example",
    "(a.b@x.example)": "a.b@x.example",
    "'a.b@x.example'": "a.b@x.example",
    "a.b@x.example;": "a.b@x.example",
    "a.b@x.example.": "a.b@x.example",
    "a.b＠x.example": "a.b@x.example",
    "a\u200b.b@x.ex\ufeffample": "a.b@x.example",
    "\xa0a.b@x.example": "a.b@x.example",
    "ab_@x.test": "ab_@x.test",
    "a@x.example; b@y.example": None,
    "a.b@localhost": None,
    "@x.example": None,
    "a.b@": None,
    "a.bx.example": None,
    "test@test.example": None,
    "unknown@unknown.example": None,
    "+999711540466": None,
    "": None,
    "   ": None,
    "n/a": None,
}
NAMES = {
    "Ann Lee": "ann lee",
    " ANN  Lee ": "ann lee",
    "Lee, Ann": "ann lee",
    "Ann\xa0Lee": "ann lee",
    "Jean-Luc O'Neil": "jean-luc o'neil",
    "Zoë Ångström": "zoë ångström",
    "Ann": None,
    "A. L.": None,
    "UNKNOWN USER": None,
    "Test Test": None,
    "N.A.": None,
    "0617540795": None,
    "a@x.example": None,
    "???": None,
    "": None,
}
PHONES = {
    "+999 648 130 167": "648130167",
    "00999648130167": "648130167",
    "(0648) 130-167": "648130167",
    "0648/130167": "648130167",
    "648.130.167": "648130167",
    "tel: 0648130167": "648130167",
    "６４８１３０１６７": "648130167",
    "+999 648": None,
    "61263": None,
    "123456789": None,
    "0123456789": None,
    "987654321": None,
    "555555555": None,
    "ex-directory": None,
    "a648130167@x.example": None,
    "": None,
}


@pytest.mark.parametrize("function,cases", [(contact.email, EMAILS), (contact.person_name, NAMES), (contact.phone, PHONES)])
def test_usable_values(spark, function, cases):
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "v string")
    got = {r.v: r.c for r in df.select("v", function(F.col("v")).alias("c")).collect()}
    assert got == {**cases, None: None}


def test_tag_is_kept_on_request(spark):
    df = spark.createDataFrame([("A+b@x.example",)], "v string")
    assert df.select(contact.email(F.col("v"), drop_tag=False)).first()[0] == "a+b@x.example"


def test_identifiers(spark):
    same = ["tuk-3963-81073", " TUK_3963_81073\n", "{tuk-3963-81073}", "tuk396381073", "tuk−3963−81073", "tuk-\u200b3963-81073", "tuk-003963-00081073", "tuk-３９６３-８１０７３", "#tuk/3963:81073"]
    df = spark.createDataFrame([(v,) for v in same], "v string")
    assert {tuple(r[0]) for r in df.select(ext_id_texts(F.col("v"))).collect()} == {("tuk-3963-81073",)}
    short = spark.createDataFrame([("bno-60-944",), ("BNO-0060-00944",), ("",), (" - ",), (None,)], "v string")
    assert [r[0] for r in short.select(ext_id_texts(F.col("v"))).collect()] == [["bno-60-944", "bno-0060-00944"]] * 2 + [None] * 3


def test_content(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"d": 2, "c": 3}}',), ('\n{"b":{"c":3,"d":2},"a":1} ',)], "v string")
    assert df.select(content(F.col("v"))).distinct().count() == 1
    odd = spark.createDataFrame([("not json ",), ("",), (None,)], "v string")
    assert [r[0] for r in odd.select(content(F.col("v"))).collect()] == ["not json", None, None]
