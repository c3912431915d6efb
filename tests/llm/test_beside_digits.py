"""Cards and IBANs that stand beside other digits or capitals."""

import re

from trackloom.llm import pii

CARD, IBAN = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"


def test_cards_and_ibans_beside_others(spark):
    given = [
        f"{CARD} 12/27", "4111111111111111 123", f"{CARD} 12/27 123", f"12 {CARD}", f"123456 {CARD} 9", f"{CARD} 123-45-6789", "1234 5678 9012 3456 123-45-6789",
        f"{CARD} 5500 0000 0000 0004 77", f"{IBAN} CODE", f"{IBAN} {CARD}", "IBAN XX89 1234 5678 9012 CODE", "4000 0000 0000 0000 006", "1234 5678 9012 3456 12/27",
    ]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonyms(df, "key").collect()}
    assert [got[i]["n_private"] for i in range(len(given))] == [1, 1, 1, 1, 1, 2, 1, 2, 1, 2, 1, 1, 0]
    for i, text in enumerate(given):
        out = got[i]["text"]
        assert re.sub("[0-9]", "0", out) == re.sub("[0-9]", "0", text)  # the layout stays
        assert not re.search(r"1111 ?1111 ?1111|0000 0000|3002 3457|123-45-6789", out), out
    assert got[0]["text"].endswith(" 12/27") and got[1]["text"].endswith(" 123") and got[3]["text"].startswith("12 ") and got[4]["text"].startswith("123456 ")
    assert got[6]["text"].startswith("1234 5678 9012 3456 ") and got[8]["text"].endswith(" CODE") and got[12]["text"] == given[12]
