"""Operators made of DataFrame functions: statements on the small tables, and edge cases."""

import duckdb
import pytest

from regimeweave.llm import exact_dedup, fair_mix, quality_rules, queries, quote_links, url_filter
from tests.helpers import sorted_rows

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns with clashing names, null id, text and source, repeated rows, ties, a long text
ODD = [
    (1, "a  b\nc", "en", "s1", 1, "x"),
    (1, "a  b\nc", "en", "s1", 1, "x"),
    (2, "a b c", None, None, None, None),
    (None, "a\tb c", "en", "s1", 1, "y"),
    (3, None, "en", "s2", 0, "y"),
    (4, "", "en", "s2", 0, "y"),
    (5, " ", "en", "s2", 0, "y"),
    (6, "word " * 40_000, "en", "s2", 0, "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA + ", kept string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_statement(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "labels"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted_rows(got.collect(), got.columns) == sorted_rows(want.fetchall(), names)


def test_exact_copies(odd, empty):
    rows = exact_dedup.refine(odd, digest_singles=True).collect()
    assert len(rows) == len(ODD)
    same = [r for r in rows if r.group_size == 4]
    assert len(same) == 4 and {r.keep_id for r in same} == {1} and sum(r.kept for r in same) == 1
    blank = [r for r in rows if r.doc_id in (3, 4)]
    assert {r.keep_id for r in blank} == {3} and [r.kept for r in rows if r.doc_id == 5] == [True]
    assert exact_dedup.drop_copies(odd).columns == odd.columns and exact_dedup.drop_copies(odd).count() == 4
    assert exact_dedup.refine(empty).count() == 0


def test_quality_rules(spark, odd, empty):
    rows = {r.doc_id: r for r in quality_rules.evaluate(odd).where("doc_id > 2").collect()}
    assert rows[3].n_words == 0 and rows[3].base_failed and rows[4].base_failed
    assert rows[6].n_words == 40_000 and rows[6].n_repeat_words == 40_000 and rows[6].base_failed
    sentence = " ".join(f"w{i}" for i in range(30)) + "."
    docs = spark.createDataFrame(
        [(1, f"{sentence}\nHome | News | About | Contact\n\nPlease see our privacy policy.\n{sentence[:-1].upper()}", "en", "s", 1), (2, "A | B | C | D\n" * 20, "en", "s", 1)], SCHEMA
    )
    kept = quality_rules.clean(docs).collect()
    assert [r.text for r in kept] == [f"{sentence}\n"] and kept[0].n_chars == len(kept[0].text)
    assert quality_rules.clean(empty).count() == 0


def test_source_mix(odd, empty):
    rows = fair_mix.queue(odd).collect()
    assert len(rows) == len(ODD)
    sizes = {r.source_size: r for r in rows}
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in rows)
    assert sum({r.source_size: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    assert len(sizes) == 3
    assert sorted(map(str, fair_mix.queue(odd).collect())) == sorted(map(str, rows))
    assert fair_mix.mix(odd).columns == odd.columns and fair_mix.queue(empty).count() == 0 and fair_mix.mix(empty).count() == 0


def test_url_rules_and_links(spark):
    link = lambda h: f'<a class=x href="http://{h}/p">l</a>'
    pages = spark.createDataFrame(
        [
            (1, "http://A.net/x", link("far.com")),
            (2, "http://a.example.net/en/1?q", None),
            (3, "https://b.example.com/de/1", link("bad.net")),
            (4, "https://b.example.com/en/1", link("c.org")),
            (5, "nothing", ""),
            (6, None, None),
            (6, "http://c.org/fr/", link("good.com")),
            (7, "http://good.com", ""),
            (8, "http://fan.com/", link("bad.net") * 2),
            (9, "http://bad.net", ""),
        ],
        "page_id long, url string, html string",
    )
    rows = url_filter.judge(pages, url_filter.rule_table(spark)).collect()
    got = {(r.page_id, r.host): r for r in rows}
    assert len(rows) == 10
    assert got[1, "a.net"].rule == "net/" and got[2, "a.example.net"].rule == "example.net/en/"
    assert got[3, "b.example.com"].verdict == "block" and got[5, ""].verdict == "allow" and got[6, ""].path == ""
    assert got[6, "c.org"].rule == "org/fr/" and got[7, "good.com"].verdict == "allow" and got[7, "good.com"].trust > 0
    assert got[8, "fan.com"].verdict == "block" and got[8, "fan.com"].rule is None
    # a bare host has an empty path, which no rule's path starts
    assert got[9, "bad.net"].rule is None and got[9, "bad.net"].verdict == "block"
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_distrust_goes_as_far_as_it_counts(spark):
    """On a chain of 30 hosts distrust fades by the damping alone, past 20 links too."""
    pages = [(i, f"http://{'h0.net' if i == 0 else f'h{i}.com'}/", "" if i == 0 else f'<a href="http://{"h0.net" if i == 1 else f"h{i - 1}.com"}/">l</a>') for i in range(30)]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), url_filter.rule_table(spark)).collect()
    whole = sum(0.85**i for i in range(30))
    for r in rows:
        want = 0.85**r.page_id / whole
        assert abs(r.distrust - want) <= 6e-3 / 30
        assert r.verdict == ("block" if want * 30 > 0.1 else "allow")
    assert {r.page_id: r.verdict for r in rows}[22] == "block"


def test_spread_does_not_depend_on_the_number_of_seeds(spark):
    """Seeds of less than a millionth each reach as many links as few large ones."""
    n = 1_200_000
    nodes = spark.range(n).selectExpr("concat('s', id) as host", f"1D / {n} as seed").union(spark.sql("select concat('c', id), 0D from range(5)"))
    edges = spark.sql("select if(id = 0, 's0', concat('c', id - 1)) as src, concat('c', id) as dst, 1D as share from range(5)")
    got = {r.host: r.score * n for r in url_filter.spread(nodes, edges).where("host like 'c%'").collect()}
    for i in range(5):
        assert abs(got[f"c{i}"] - 0.85 ** (i + 1)) < 0.01


def test_quotes(spark):
    rows = [
        ("c", 0, "u", "First line.\nsecond Line"),
        ("c", 1, "a", "other"),
        ("c", 2, "u", "> Second  line\n> > unknown\nmine"),
        ("c", 3, "a", ">> second line\n> Mine\nlast"),
        ("d", 0, "u", "> mine\nalone"),
        (None, None, "u", None),
        ("c", 2, "u", "twice"),
    ]
    got = quote_links.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    at = {(r.conv_id, r.turn, r.body): r for r in got}
    assert len(got) == len(rows)
    assert at["c", 2, "mine"].parent_turn == 0 and at["c", 2, "mine"].quote_depth == 2
    last = at["c", 3, "last"]
    assert (last.parent_turn, last.thread_root, last.reply_depth, last.position) == (2, 0, 2, 3)
    assert at["c", 1, "other"].position == 4 and at["d", 0, "alone"].parent_turn is None and at[None, None, ""].position == 0
