"""Personal data that stands after an earlier match, before its context word, or before capitals."""

import hashlib
import re
import time

from terracover.llm import pii

MASKED = {
    "ssn 078-05-1120 and 078-05-1120": "ssn [SSN] and [SSN]",
    "078-05-1120 is my social security number": "[SSN] is my social security number",
    "order 078-05-1120 shipped": "order 078-05-1120 shipped",
    "ssn" + "." * 60 + "078-05-1120" + "." * 60 + "ssn": "ssn" + "." * 60 + "078-05-1120" + "." * 60 + "ssn",
    "ES91 2100 0418 4502 0005 1332 VISA": "[IBAN] VISA",
    "ES9121000418450200051332 VISAcard": "[IBAN] VISAcard",
    "é DE89 3704 0044 0532 0130 00 ES91 2100 0418 4502 0005 1332 AND MORE": "é [IBAN] [IBAN] AND MORE",
    "REF 2024 XX12 DE89 3704 0044 0532 0130 00.": "REF 2024 XX12 [IBAN].",
    "DE89370400440532013001 and DE8937040044053201300000": "DE89370400440532013001 and DE8937040044053201300000",
}


def test_redaction_leaves_none(spark):
    df = spark.createDataFrame(list(enumerate(MASKED)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert [got[k] for k in range(len(MASKED))] == list(MASKED.values())


def test_ibans_are_counted(spark):
    df = spark.createDataFrame(list(enumerate(MASKED)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert [got[k].n_iban for k in range(len(MASKED))] == [x.count("[IBAN]") for x in MASKED.values()]
    assert got[4].spans.split(",")[-1] == "iban:0:29"


def test_many_spans_cost_linear_time(spark):
    """300 kB of addresses, more spans than a fold gathers at once: all found, all masked, within seconds."""
    n = 26_000
    text = " ".join(f"10.{i % 256}.{i // 256}.7é" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.digest(df).first()
    want = [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9.]+", text)]
    assert got.n_ip == n and got.spans == ",".join(want) and got.base_sha256 == hashlib.sha256(got.spans.encode()).hexdigest()
    assert pii.redacted(df).first().text == " ".join(["[IP]é"] * n)
    assert time.time() - began < 60


def test_many_ibans(spark):
    text = "DE89 3704 0044 0532 0130 00 and " * 700
    df = spark.createDataFrame([(1, text, "mine")], "doc_id long, text string, found string")
    assert pii.digest(df).first().n_iban == 700
    assert pii.redacted(df).first().asDict() == {"doc_id": 1, "text": "[IBAN] and " * 700, "found": "mine"}
