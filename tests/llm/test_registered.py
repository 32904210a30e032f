"""Registered queries as a whole: against their SQL on made tables, and on the smallest tables against brute force."""

import hashlib
import random
import time

import duckdb
import pytest

from cadenza.llm.queries import ORACLES, QUERIES
from cadenza.llm.urls import named_targets

SF = "/root/testdata/sf0.001"


def by_sql(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.sql(ORACLES[name])
    return sorted((tuple(r[k] for k in sorted(range(len(found.columns)), key=lambda k: found.columns[k])) for r in found.fetchall()), key=str)


def by_spark(spark, folder, name):
    found = QUERIES[name](spark, str(folder))
    return sorted((tuple(r[c] for c in sorted(found.columns)) for r in found.collect()), key=str)


def linked_pages():
    rng = random.Random(2)
    link, fresh = '<LINK rel="canonical" href="{}">', "<meta content='5;URL={}' http-equiv='Refresh'>"
    host = lambda k: rng.choice(["a{}.org", "b{}.example.net", "c{}.net", "www.Example.COM"]).format(k)
    rows = [(f"http://s.org/{k}?x", (link if k % 2 else fresh).format("//hub.org/a" if k % 3 else "HTTP://HUB.org/a")) for k in range(300)]  # a giant component
    rows += [(f"http://chain.org/p/{k}", link.format(f"{k + 1}")) for k in range(40)] + [("http://chain.org/p/40#z", fresh.format("http://end.net/"))]
    rows += [(f"https://{host(k)}/{rng.choice(['en/', 'de/', 'fr/', ''])}{k}", rng.choice([link, fresh]).format(rng.choice(["../x", "./y/../z", "?q=1&amp;r=2", "/en/..", f"http://{host(k)}/de/", "#t", "mailto:x", "", "http://", ".."]))) for k in range(300)]
    rows += [("http://s.org/3?x", None)] * 5 + [(None, link.format("http://end.net/")), ("foo", fresh.format("/x")), ("", ""), ("x://", link.format("http://end.net/")), ("http://multi.org/1", link.format("/2") + fresh.format("http://end.net/"))]
    hidden = ["<!-- {} -->", "<!-- > {}", "<script>'{}'</script>", "<STYLE a>{}", "<link {}", "<!-->{}<!-- -->"]
    shown = ["<!-- x -->{}", "<script>1</SCRIPT >{}", "<style></style>{}", "<link {0}{0}", "<script></script {}>{}"]
    rows += [(f"http://{name}.com/{k}", h.replace("{}", link.format("http://end.net/")).replace("{0}", fresh.format("http://end.net/"))) for name, pages in (("hidden", hidden), ("shown", shown)) for k, h in enumerate(pages)]
    return [(k, u, h) for k, (u, h) in enumerate(rows)]


def test_url_filters_against_sql(spark, tmp_path):
    pages = spark.createDataFrame(linked_pages(), "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = by_spark(spark, tmp_path, "op8_url_filters")
    assert got == by_sql(tmp_path, "op8_url_filters", "pages")
    verdicts = {u: r[4] for r in got for k, u, _ in linked_pages() if k == r[1] and u and ("hidden.com" in u or "shown.com" in u)}
    assert {u for u, v in verdicts.items() if v == "block"} >= {f"http://shown.com/{k}" for k in range(4)}
    assert {u for u, v in verdicts.items() if v == "allow"} >= {f"http://hidden.com/{k}" for k in range(4)}
    inherited = {r[1] for r in got if r[3] is None and r[4] == "block"}
    assert {0, 2, 300, 339} & inherited == {300, 339}  # the chain ends at a blocked host, the hub says nothing


def test_unclosed_tags_take_linear_time(spark):
    rows = [("http://a.org/", f"{opened} canonical " * 100_000) for opened in ("<link", "<meta", "<!--", "<script", "<style", "<link rel=")]
    start = time.time()
    assert named_targets(spark.createDataFrame(rows, "u string, h string"), "u", "h").isEmpty()
    assert time.time() - start < 20


def test_chat_formatting_against_sql(spark, tmp_path):
    rng = random.Random(4)
    part = lambda: rng.choice(["### ", "</turn>", "\\", "\\s", "\n", ": ", "é", "plain words", "", "\\h\\e\\c", "assistant"])
    rows = [(rng.randrange(30), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", None, "a:b"]), rng.choice([None, "".join(part() for _ in range(rng.randrange(9)))])) for _ in range(400)]
    rows += [(99, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert by_spark(spark, tmp_path, "op1_chat_formatting") == by_sql(tmp_path, "op1_chat_formatting", "conversations")


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_quality_rules", "op7_packing", "op9_line_dedup", "op10_quality_classifier"])
def test_returns_every_document(spark, name):
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    got = [r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(set(got) if name == "op7_packing" else got) == ids


def test_substring_dedup_of_the_table(spark):
    seen, want = set(), []
    for d, t in sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        b = t.encode()
        hit = bytearray(len(b))
        for i in range(len(b) - 99):
            w = hash(b[i : i + 100])
            if w in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(w)
        want.append((hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest(), d, sum(hit)))
    assert sorted((r["kept_sha256"], r["doc_id"], r["n_removed"]) for r in QUERIES["op3_substring_dedup"](spark, SF).collect()) == sorted(want)


def test_html_extraction_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = QUERIES["op4_html_extraction"](spark, SF)
    assert got.count() == pages.count() and got.where("n_chars <> char_length(text)").isEmpty() and got.where("n_chars > 0").count() > 0
