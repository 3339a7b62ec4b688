from tessellar.llm import scans

CLEAN = "The audit committee of Acme Holdings published a long-term policy on targets. The committee reports on climate risk and further details. "
NOISY = "The audit com-\nmittee of Acme Holdings publ1shed a long-\nterm policy on targets. The comrnittee\n   12\nAcme Holdings Yearly Review\nreports on climate risk.\n\nFur­\nther details and targefs."
COLS = "chunk_id string, document string, page string, heading string, chunk string, ingested_at string, kind string, n int, l string"


def pool(spark, extra=()):
    rows = [(f"c{i}", "other_ar_2020.pdf", "1", "Climate risk", CLEAN * 4, "a") for i in range(40)]
    rows += [(f"h{i}", "acme_holdings_ar_2021.pdf", str(i), "Acme Holdings Yearly Review\nClimate risk", CLEAN + "\nAcme Holdings Yearly Review", "a") for i in range(3)]
    rows += [("x", "acme_holdings_ar_2021.pdf", "p. 11", "7   Climate risk", NOISY, "a"), ("y", "acme_holdings_ar_2021.pdf", "3", "Climate ri-\nsk ..... 4", None, "a"), *extra]
    return spark.createDataFrame([(*r, "k", 1, "z") for r in rows], COLS)


def test_lines(spark):
    odd = [("e", "", None, "", "", "a"), ("n", None, None, None, None, None), (None, "d", "1", "H", "text", "a"), ("x", "acme_holdings_ar_2021.pdf", "p. 11", "7   Climate risk", NOISY, "a")]
    got = {tuple(r)[1:] for r in scans.found(pool(spark, odd)).collect() if r["chunk_id"] == "x"}
    want = {("chunk", 0, "hyphen"), ("chunk", 1, "misread"), ("chunk", 2, "misread"), ("chunk", 3, "pageno"), ("chunk", 4, "header"), ("chunk", 7, "hyphen"), ("chunk", 8, "misread"), ("heading", 0, "pageno")}
    assert got == want
    heads = {tuple(r) for r in scans.found(pool(spark)).collect() if r["field"] == "heading" and r["chunk_id"] in ("h0", "y")}
    assert heads == {("h0", "heading", 0, "header"), ("y", "heading", 0, "hyphen"), ("y", "heading", 1, "pageno")}


def test_reflow(spark):
    r = next(r for r in scans.reflow(scans.read_lines(pool(spark))).collect() if r["chunk_id"] == "x")
    assert r["heading"] == "Climate risk"
    assert r["chunk"] == "The audit committee of Acme Holdings published a long-term policy on targets. The committee reports on climate risk.\n\nFurther details and targets."


def test_empty(spark):
    assert scans.found(pool(spark).limit(0)).count() == 0
    assert scans.reflow(scans.read_lines(pool(spark).limit(0))).count() == 0


def test_page_forms():
    yes = ["[12]", "- 7 -", "– 8 –", "12 |", "Page 3 of 90", "xiv", "p. 9"]
    no = ["12.5", "2023", "mild", "Page", "| 3 | 4 |", "in 2023"]
    assert all(map(scans.is_dressed_page, yes)) and not any(map(scans.is_dressed_page, no))


def test_rare_words_of_a_large_corpus_keep_their_counts(spark):
    rows = [(f"f{i:02d}", "d", "1", "Filler", "filler " * 100_000, "a") for i in range(35)]
    rows += [(f"r{i:02d}", "d", "1", "Rare", "near the barn stood", "a") for i in range(30)]
    rows += [(f"w{i}", "d", "1", "Rare", "he said bam loudly", "a") for i in range(3)]  # a word of its own, a tenth as frequent
    assert scans.found(spark.createDataFrame([(*r, "k", 1, "z") for r in rows], COLS)).filter("kind = 'misread'").count() == 0
