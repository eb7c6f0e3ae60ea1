"""Hand-computed cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from vellumgrid.functions import html, models, text
from vellumgrid.functions.fixed import REFUSAL
from vellumgrid.operators import answers, chunking, evaluation, understand


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cells", "expected"),
    [(["$", "65,821", "(9)", "%"], ["65,821", "(9)%"]), (["2024", "$", "%"], ["2024", "$", "%"]), (["$ 1,234"], ["1,234"]), (["a", "", "b"], ["a", "b"]), (["$", "0.83 – 0.91"], ["0.83 – 0.91"]), (["$", "%"], ["$", "%"]), (["5", "%", "%"], ["5%", "%"]), (["$", "$", "—"], ["$", "—"]), (["$5", "%)"], ["5%)"]), ([], [])],
)
def test_cells(cells, expected):
    assert html.clean_cells(cells) == expected


def test_page_text():
    assert html.page_text('<div style="display: none">x</div>y') == "y"
    assert html.page_text("<tr><td>a</td><td>b</td></tr>") == "a | b"
    assert html.page_text("<head><title>t</title></head><p>one&amp;two</p><script>z</script><p>three</p>") == "one&two\nthree"
    assert html.page_text("") == ""
    assert html.page_text("a</p>b") == "ab"  # the end of nothing
    assert html.page_text('a<span style="display:none"><div>x</div></span>b') == "ab"  # nothing hidden breaks
    assert html.page_text("<table><tr><td>a</td><td/><td>b</td></tr></table>") == "a | b"
    assert html.page_text("a<br/>b<p>c") == "a\nb\nc"
    assert html.page_text("<td>x<p>y</p></td>") == "x y"



def test_sections():
    body = "Item 1. Business\nItem 2. Properties\nItem 1. Business\nmakes things\n12\nItem 2. Properties\nland\nSIGNATURES\nA. Name"
    found = dict(html.sections(body))
    assert list(found) == ["1", "2", "signatures"]
    assert found["1"] == "Item 1. Business\nmakes things"
    assert found["signatures"] == "SIGNATURES\nA. Name"
    assert html.sections("Item 1. x") == []
    assert html.sections("") == []


def test_headings_over_a_line_end():
    assert dict(html.sections("Report\nItem\n1. Business\nmakes things\nITEM\n\n7. Discussion\nmore")) == {"1": "Item\n1. Business\nmakes things", "7": "ITEM\n\n7. Discussion\nmore"}
    assert html.sections("Report\nAn item\n1. x\nItem one") == []


def test_ends_of_nothing_take_linear_time():
    import time

    began = time.time()
    assert html.page_text("<p>" * 200_000 + "</q>" * 200_000 + "x</p>y") == "x\ny"
    assert time.time() - began < 10


def test_appendix_moves_to_item_8():
    body = "x\nItem 7. a\nItem 8. b\nstatements\nsignatures\nsigned\nReport of Independent Registered Public Accounting Firm\n" + "z" * 20_001
    found = dict(html.sections(body))
    assert "Report of Independent" in found["8"] and found["signatures"] == "signatures\nsigned"


@pytest.mark.parametrize(("line", "expected"), [("Human Capital", True), ("Total", False), ("See note.", False), ("PART II", False), ("a | b", False), ("Cash | 1", False), (" Human Capital\u00a0", True), ("  total ", False)])
def test_heading(spark, line, expected):
    assert chunking.heading(line) is expected
    assert one(spark, text.is_heading(F.lit(line))) is expected


@pytest.mark.parametrize(("line", "expected"), [("12", True), ("PART II", True), ("Item 7", True), ("Table of Contents", True), ("Item 7.", False)])
def test_noise(spark, line, expected):
    assert one(spark, text.is_noise(F.lit(line))) is expected


def test_ids_and_names(spark):
    lit = F.lit
    assert one(spark, text.chunk_id(lit("F"), lit("2025"), lit("7"), lit(1))) == "F-2025-7-001"
    assert one(spark, text.chunk_id(lit("F"), lit("2025"), lit("7"), lit(1000))) == "F-2025-7-1000"
    assert one(spark, text.section_name(lit("1a"))) == "Item 1A"
    assert one(spark, text.section_title(lit("1a"))) == "Risk Factors"
    with pytest.raises(Exception, match="unknown section"):
        one(spark, text.section_title(lit("99")))
    assert one(spark, text.normal_space(lit(" a \n b "))) == "a b"


@pytest.mark.parametrize(
    ("question", "expected"),
    [("Who is the CEO of all companies?", '"ceo" OR "chief executive officer"'), ("What is it?", None), ("Ford's profit in fiscal 2024", '"ford" OR "profit" OR "net income"')],
)
def test_keyword_query(spark, question, expected):
    assert one(spark, understand.keyword_query(F.lit(question))) == expected


@pytest.mark.parametrize(("year", "expected"), [("2023", ["2024", "2025"]), ("2022", ["2024"]), ("2015", ["2015"]), ("2024", ["2024"]), ("2025", ["2025"])])
def test_years(spark, year, expected):
    loaded = F.array(*map(F.lit, ("2024", "2025", "2026")))
    assert one(spark, understand.years_loaded(F.array(F.lit(year)), loaded)) == expected


def test_written_filters(spark):
    assert one(spark, understand.years_written(F.lit("ASU 2023-09 and $2,025 but FY2024"))) == ["2024"]
    assert one(spark, understand.sections_written(F.lit("Item 7a and the signature page"))) == ["Item 7A", "Signature page"]


def test_companies(spark):
    aliases = {"F": ["Ford"], "GM": ["General Motors", "GM"], "AAPL": ["Apple"]}
    ask = lambda q: one(spark, understand.companies(F.lit(q), aliases, ["F", "GM"]))
    assert ask("gm") == [] and ask("GM") == ["GM"] and ask("ford") == ["F"]
    assert ask("Which companies grew?") == ["F", "GM", "AAPL"]
    assert one(spark, understand.without_companies(F.lit("Ford's sales"), aliases, ["F"])) == "  sales"


def test_explicit_filters_win(spark):
    asked = spark.createDataFrame([("Ford and GM", [], None)], "question string, tickers array<string>, years array<string>")
    aliases = {"F": ["Ford"], "GM": ["GM"]}
    row = understand.filters(asked, aliases, ["F", "GM"], F.array(F.lit("2025"))).first()
    assert row["tickers"] == [] and row["years"] == []
    row = understand.filters(asked.withColumn("tickers", F.array(F.lit("gm"))), aliases, ["F", "GM"], F.array(F.lit("2025"))).first()
    assert row["tickers"] == ["GM"]
    row = understand.filters(asked.drop("tickers"), aliases, ["F", "GM"], F.array(F.lit("2025"))).first()
    assert row["tickers"] == ["F", "GM"] and row["years"] == ["latest"]


def test_citations(spark):
    labels = F.array(F.lit("one"), F.lit("two"))
    expand = lambda x: one(spark, answers.expand_citations(F.lit(x), labels))
    assert expand("x [S1, S3].") == "x [one][unknown source S3]." and expand("[S2]") == "[two]" and expand("") == ""
    assert expand("[S99999999999] a [S1][S2;S1]") == "[unknown source S99999999999] a [one][two][one]"
    assert answers.extractive("q", []) == REFUSAL == "Not found in the filings."
    claims = lambda x: [(r["claim"], [int(n) for n in r["refs"]]) for r in one(spark, answers.claim_rows(F.lit(x)))]
    assert claims("- Sales rose [S2]. Costs [S1]\n[S3]") == [("Sales rose", [2]), (". Costs", [1]), ("", [3])]
    assert claims("A [S3][S1; S1] b") == [("A", [3, 1, 1])] and claims("") == [] == claims("none\r\n\n")


def test_uncited_lines(spark):
    lines = {"In 2025 costs rose": False, "Not in the excerpts: 2,000 units": False, "Staff of 1,200": True, "3.5 or 4": False, "5 million [S1]": False, "5 million": True, "On May 20": False}
    assert one(spark, answers.uncited_lines(F.lit("\n".join(lines)))) == [x for x, flag in lines.items() if flag]


def test_a_long_answer_takes_linear_time(spark):
    import time

    began = time.time()
    assert spark.createDataFrame([("12 " * 700_000,)], "t string").select(F.size(answers.written_numbers(F.col("t"), True))).first()[0] == 700_000
    assert time.time() - began < 25


def test_numbers(spark):
    told = lambda x, answer: [(r["written"], r["value"], r["allow"]) for r in one(spark, answers.written_numbers(F.lit(x), answer))]
    assert [w for w, _, _ in told("On October 1 2025, 3 of 12 sold $3,100 million", True)] == ["12", "3,100 million"]
    assert told("3.1 billion", False) == [("3.1 billion", 3.1e9, 0.05e9)]
    assert told("a1 v2.5 10-K 7% 1,2, 2,025 1999 1999% .5 8", False) == [("1", 1.0, 0.5), ("7%", 7.0, 0.5), ("1,2", 12.0, 0.5), ("2,025", 2025.0, 0.5), ("1999%", 1999.0, 0.5), ("8", 8.0, 0.5)]
    assert told("", True) == []


def test_fact_and_support(spark):
    assert one(spark, text.fact_found(F.lit("416,161|416.2 billion"), F.lit("$416.2 billion")))
    assert one(spark, text.near_any(F.lit(3.1e9), text.scaled(F.array(F.lit(3.1))), F.lit(0.0)))
    assert not one(spark, text.near_any(F.lit(3.2e9), text.scaled(F.array(F.lit(3.1))), F.lit(0.0)))
    assert one(spark, text.near_any(F.lit(169000.0), text.scaled(F.array(F.lit(169.0))), F.lit(0.0)))


def test_rates(spark):
    rows = spark.createDataFrame([("a", i < 39) for i in range(41)], "kind string, hit boolean")
    got = {r["kind"]: r["hit"] for r in evaluation.rates(rows, "kind", ["hit"]).collect()}
    assert got == {"a": 95.1, None: 95.1}
    assert rows.limit(0).agg(text.percent(F.col("hit")).alias("x")).first()["x"] == 0.0


@pytest.mark.parametrize(("word", "expected"), [("caresses", "caress"), ("ponies", "poni"), ("employed", "emploi"), ("employees", "employe"), ("relational", "relat"), ("hopping", "hop"), ("rate", "rate")])
def test_stem(word, expected):
    assert models.stem(word) == expected


def test_packing():
    assert chunking.pack("") == [] and chunking.pack(None) == []
    long = "\n".join(f"Sentence number {i} has some words in it." for i in range(200))
    packed = chunking.pack(long)
    assert all(chunking.count(c) <= 480 for c in packed) and len(packed) > 3
    assert packed[0].split("\n")[-1] in packed[1]  # overlap
    headed = "\n".join(["word " * 120, "Human Capital", "more " * 120])
    assert chunking.pack(headed)[1].startswith("Human Capital")
    assert all(chunking.count(u) <= 480 for u, _ in chunking.units("x " * 2000))


def plain_spans(sizes, breaks):
    """Chunks by one unit after the other."""
    out, current, repeated, topic = [], [], 0, False
    size = lambda units: sum(sizes[u] for u in units)
    for u in range(len(sizes)):
        if u in breaks and size(current[repeated:]) >= 100:
            out, current, repeated, topic = [*out, current], [], 0, True
        elif current and (size(current) >= 380 or size(current) + sizes[u] > 480):
            tail = [t for t in current if size(current[current.index(t) :]) <= 50]
            out.append(current)
            current = tail if size(tail) + sizes[u] <= 480 else []
            repeated, topic = len(current), False
        current = [*current, u]
    new = current[repeated:]
    if out and not topic and size(new) < 100 and size(out[-1] + new) <= 480:
        out[-1] = out[-1] + new
    elif new:
        out.append(current)
    return [(c[0], c[-1] + 1) for c in out]


def test_spans_are_those_of_one_unit_after_the_other():
    import random

    rng = random.Random(0)
    for _ in range(500):
        sizes = [rng.choice([0, rng.randint(1, 40), rng.randint(1, 200), rng.randint(200, 480)]) for _ in range(rng.randint(0, 50))]
        breaks = sorted(rng.sample(range(len(sizes)), rng.randint(0, min(len(sizes), 8))))
        assert chunking.spans(sizes, breaks) == plain_spans(sizes, breaks)


@pytest.mark.parametrize("text", ["\n" * 2_000_000, "a" + " b" * 1_000_000, "ab," * 700_000])
def test_long_sections_take_linear_time(text):
    import time

    began = time.time()
    chunks = chunking.pack(text)
    assert time.time() - began < 20 and all(chunking.count(c) <= 480 for c in chunks)


def test_question_checks(spark):
    sections = spark.createDataFrame([("F", "2025", "Item 7", "Sales  rose\nto 5 million."), ("F", "2024", "Item 7", "Costs fell.")], "ticker string, year string, section string, text string")
    good = [("F", "2025", "Item 7", "Sales rose to 5")]
    rows = [
        (1, "fact", "q", "up", ["5|five"], good, None),
        (2, "fact", "q", "up", ["up"], [("F", "2025", "Item 7", "Sales fell")], None),
        (3, "fact", "q", "up", ["rose"], [("F", "2025", "Item 8", "Sales rose")], None),
        (4, "fact", "q", "up", ["down|fell"], [*good, ("F", "2024", "Item 7", "Costs")], None),
        (5, "fact", None, "up", ["down"], good, None),
        (6, "fact", "q", "up", ["up"], good, None),
        (6, "no_answer", "q", REFUSAL, [], [], "searched"),
    ]
    kind = "id long, type string, question string, expected_answer string, key_facts array<string>, sources array<struct<ticker:string,year:string,section:string,quote:string>>, note string"
    checked = evaluation.question_checks(spark.createDataFrame(rows, kind), sections, ["fact", "summary", "comparison", "no_answer"], REFUSAL)
    assert sorted((r["id"], r["errors"]) for r in checked.collect()) == [
        (1, []),
        (2, ["quote not in section: F 2025 Item 7"]),
        (3, ["section not found: F 2025 Item 8", "key fact not in evidence: rose"]),
        (4, ["key fact not in evidence: down|fell"]),
        (5, ["missing field question"]),
        (6, ["duplicate id"]),
        (6, ["duplicate id"]),
    ]


def test_citation_check(spark):
    raw = "Sales were $3.1 billion [S1][S2]\nCosts rose 12% [S2].\nIn 2025 see Item 7 of the 10-K\nOn May 20 it paid 2.5\nNot in the excerpts: 55\nStaff of 1,200\nNo number [S1]\nTotal 77 [S9]"
    rows = [(1, raw, False, ["3,100 in millions", "grew 11.4%"]), (2, "44", True, []), (3, None, False, None)]
    got = {r["id"]: r.asDict(True) for r in answers.checked(spark.createDataFrame(rows, "id long, raw_answer string, declined boolean, texts array<string>")).collect()}
    assert got == {
        1: {"id": 1, "claims": 4, "claims_with_numbers": 3, "numbers": 3, "unsupported": [{"number": "12%", "cites": ["S2"], "claim": "Costs rose 12%"}, {"number": "77", "cites": ["S9"], "claim": "Total 77"}], "uncited_lines": ["Staff of 1,200"]},
        3: {"id": 3, "claims": 0, "claims_with_numbers": 0, "numbers": 0, "unsupported": [], "uncited_lines": []},
    }
