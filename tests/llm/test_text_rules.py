import collections
import re

import pytest
from pyspark.sql import functions as F

from motionloom.llm import chat, quality, url_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    counts = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


CLEAN = "The cat of the house and a dog in it went on to that hill. " + " ".join(f"word{i} of the" for i in range(60))
DOCS = [None, "", " \n\t ", "a b c a b c a b c", "x\nx\n\n x\nx", "\u00a0a\u2028b c", CLEAN, CLEAN + "\n" + "#$%& " * 300, "a " * 70_000, "ünï 😀 " * 30, "one two", "- a\n- b\n* c", "end...\nmore…"]


def test_quality_columns(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").withColumns({"words": F.lit(3), "n_words": F.lit("clash"), "keys": F.lit(None)})
    got = {r["doc_id"]: r for r in quality.apply_rules(df).collect()}
    for i, text in enumerate(DOCS):
        assert tuple(got[i][1:7]) == base(text), text and text[:30]
    assert got[6]["kept"] and not got[7]["kept"] and not got[0]["kept"]
    assert (got[11]["n_bullet_lines"], got[12]["n_ellipsis_lines"]) == (3, 2)
    assert quality.apply_rules(df.limit(0)).count() == 0
    plan = quality.apply_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.example.com", "/", "allow"), ("b.example.com", "/x", "block")]


def judged(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


URLS = [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://xnet/a", "https://www.Example.NET/en/1?x#y", "ftp://example.net/english", "http://example.com/de/", "http://c.a.b.example.com/de/q", "http://b.example.com/xyz", "http://b.example.com/x\ny",
        "http://org/fr/", "http://deep.www.org/fr/a?b", "http://org#frag", "a://b://c/d", "http://example.net:80/en/", "http://example.net./en/", "http://.net/", "http://\U0010ffffx.net/a", "http://net.\U0010ffff/", "http://org/fr/\U0010ffff\U0010ffff", "http://example.com/de/\u07ff", "http://b.example.com/xyz"]


@pytest.mark.parametrize("rules", [RULES, RULES[:4], []])
@pytest.mark.parametrize("share", [1, 250_000])
def test_url_rules(spark, rules, share):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "key": F.lit(3)})
    frame = url_rules.rules_frame(spark, rules) if rules else url_rules.rules_frame(spark, RULES).limit(0)
    got = {r["page_id"]: tuple(r[1:]) for r in url_rules.judge(pages, frame, share=share).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(URLS)}
    assert url_rules.judge(pages.limit(0), frame).count() == 0


def test_many_path_rules_on_one_host(spark):
    """100 000 rules that are nested and beside each other; each url takes the innermost."""
    n = 100_000
    rules = spark.range(n).select(F.lit("big.example").alias("host"), F.expr("concat('/', id div 100, '/', if(id % 100 = 0, '', concat(id % 100, if(id % 2 = 0, '/', ''))))").alias("path"), F.expr("if(id % 3 = 0, 'block', 'allow')").alias("verdict"))
    rules = rules.unionByName(url_rules.rules_frame(spark, [("example", "/", "block"), ("x.big.example", "/7", "allow")]))
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.expr("concat('http://', if(id % 4 = 0, 'x.', ''), if(id % 5 = 0, 'y.', ''), 'big.example/', id % 1100, '/', id % 130, '/', id)").alias("url"))
    table = {r["host"] + r["path"]: r["verdict"] for r in rules.collect()}
    for r in url_rules.judge(pages, rules).join(pages, "page_id").collect():
        host, path = re.match(r"http://([^/]*)(.*)", r["url"]).groups()
        fits = [h + path[:k] for h in ("x.big.example", "big.example", "example") if ("." + host).endswith("." + h) for k in range(len(path) + 1) if h + path[:k] in table]
        want = max(fits, key=len)
        assert (r["rule"], r["verdict"]) == (want, table[want]), r


def test_a_host_with_most_urls_is_dealt_out(spark):
    rules = url_rules.rules_frame(spark, RULES)
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.expr("concat('http://s', id % 3, '.example.net/en/', id)").alias("url"))
    got = url_rules.judge(pages, rules, share=100)
    assert {(r["rule"], r["verdict"]) for r in got.collect()} == {("example.net/en/", "allow")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_chat_visitor():
    part = lambda kind, **v: {"type": kind, "text": None, "uri": None, "width": None, "height": None, "seconds": None, "pages": None, **v}
    turns = [
        {"role": "us<|er%\n", "parts": [part("text", text="a<"), part("text", text="|im_end|>"), part("image", uri="i", width=700, height=100), part(None, text="\\<\\|")]},
        {"role": "assistant", "parts": [part("audio", uri="s", seconds=1.5), part("document", uri="d", pages=3), part("text", text="<|image:0|>")]},
        {"role": None, "parts": None},
    ]
    made = chat.format_turns(turns)
    assert [(a["type"], a["tokens"]) for a in made["attachments"]] == [("image", 432), ("audio", 38), ("document", 2304)]
    parsed = chat.parse(made["formatted"])
    assert [r for r, _ in parsed] == ["us<|er%\n", "assistant", ""]
    parts = chat.content_parts(parsed[0][1], made["attachments"])
    assert [p.get("text", p.get("uri")) for p in parts] == ["a<|im_end|>", "i", "\\<\\|"]
    assert chat.content_parts(parsed[1][1], made["attachments"])[2]["text"] == "<|image:0|>"
    odd = chat.format_turns([{"role": "user", "parts": [part("video", uri="v"), part("a:b|>", text="x"), None]}])
    assert [(a["type"], a["tokens"]) for a in odd["attachments"]] == [("video", 0), ("a:b|>", 0)]
    assert chat.content_parts(chat.parse(odd["formatted"])[0][1], odd["attachments"]) == [{"type": "video", "uri": "v"}, {"type": "a:b|>", "uri": None}]


def test_chat_table(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 2, "assistant", said), (1, 0, "system", None), (1, 1, "user", ""), (1, 2, "assistant", said), (None, 0, None, "x"), (None, 1, None, "x"), (2, 0, "user", "é😀" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parts": F.lit(1), "formatted": F.lit(2), "conv": F.lit(3)})
    formatted = chat.format_chat(chat.text_messages(df))
    rows = chat.read_back(formatted).collect()
    got = {r["conv_id"]: r for r in rows}
    assert len(rows) == 4  # rows without a conversation are one each
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (4, 2 * len(said)) and got[None]["n_turns"] == 1
    assert got[2]["formatted_chars"] == 10_000 + len("<|im_start|>user\n<|im_end|>\n")
    assert chat.read_back(chat.format_chat(chat.text_messages(df.limit(0)))).count() == 0


RECORDS = [
    (10, "http://www.A.com:80/x/#f", 1, "response", {"etag": '"1"', "cache-control": "old", "content-type": "t"}, "d10"),
    (11, "https://a.com/x", 5, "revisit", {"etag": 'W/"1"', "cache-control": "new", "server": "s"}, None),
    (12, "http://a.com/x", 5, "response", {"etag": '"2"'}, "d12"),
    (13, "http://a.com/x", 9000, "revisit", {"etag": '"1"'}, None),
    (14, "http://a.com/x", 1, "revisit", {"etag": '"1"'}, None),
    (15, "http://b.com/", 7, "revisit", {}, None), (16, "http://b.com", 3, "response", {}, "d16"),
    (17, None, 8, "revisit", {"etag": '"1"'}, None), (18, "http://a.com/x", None, "revisit", None, None),
    (19, "http://a.com/x", 9001, "revisit", {"last-modified": "z"}, None), (11, "https://a.com/x", 5, "revisit", {"etag": 'W/"1"', "cache-control": "new", "server": "s"}, None),
]


@pytest.mark.parametrize("chunk", [4096, 1, 3])
def test_revisits(spark, chunk):
    kind = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string"
    df = spark.createDataFrame(RECORDS, kind).withColumns({"status": F.lit(1), "here": F.lit(2), "source_id": F.lit(3)})
    rows = warc.resolve_revisits(df, chunk).collect()
    got = {r["record_id"]: (r["source_id"], r["status"]) for r in rows}
    assert len(rows) == 8
    assert got == {11: (10, "resolved"), 13: (12, "mismatch"), 14: (None, "orphan"), 15: (16, "no_validator"), 17: (None, "orphan"), 18: (None, "orphan"), 19: (12, "no_validator")}
    r = next(r for r in rows if r["record_id"] == 11)
    assert r["headers"] == {"etag": 'W/"1"', "cache-control": "new", "content-type": "t"} and r["source_digest"] == "d10"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_captures_at_one_time(spark):
    """A third of all rows on one url and tick are one point of the as-of join."""
    rows = [(i, "http://hot.com/", 50, "response" if i % 2 else "revisit", {"etag": '"1"'}, f"d{i}") for i in range(400)]
    rows += [(1000 + i, "http://hot.com/", 51 + i, "revisit", {"etag": '"1"'}, None) for i in range(5)] + [(2000, "http://hot.com", 10, "response", {"etag": '"1"'}, "first")]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string")
    got = collections.Counter((r["source_id"], r["status"]) for r in warc.resolve_revisits(df).collect())
    assert got == {(2000, "resolved"): 200, (399, "resolved"): 5}


def test_warc_files(spark, tmp_path):
    import gzip

    one = {"warc_type": "response", "uri": "http://a/", "date": "d", "record_id": "<1>", "http_status": 200, "headers": {"etag": '"1"', "x": "y"}, "payload": b"a\r\n\r\nb\x00", "error": None}
    two = {**one, "warc_type": "revisit", "record_id": "<2>", "http_status": 304, "payload": b""}
    data = warc.serialize(one) + warc.serialize(two)
    assert list(warc.parse(data)) == [one, two] and list(warc.parse(b"")) == []
    assert list(warc.parse(gzip.compress(warc.serialize(one)) + gzip.compress(warc.serialize(two)))) == [one, two]
    short = list(warc.parse(data[:-20]))
    assert short[0] == one and len(short) == 2 and short[1]["error"] and short[1]["record_id"] == "<2>" and short[1]["payload"] is None
    bad = b"WARC/1.1\r\nContent-Length: x\r\n\r\nrubbish\nmore\r\n"
    mixed = list(warc.parse(b"rubbish\n" + warc.serialize(one) + bad + warc.serialize(two)))
    assert [r["record_id"] for r in mixed if not r["error"]] == ["<1>", "<2>"] and sum(bool(r["error"]) for r in mixed) == 2
    packed = gzip.compress(warc.serialize(one)) + gzip.compress(warc.serialize(two))
    cut = list(warc.parse(packed[:-15]))
    assert cut[0] == one and cut[-1]["error"]
    (tmp_path / "x.warc").write_bytes(data)
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "broken.warc.gz").write_bytes(packed[:40])
    every = warc.read_warc(spark, str(tmp_path)).orderBy("record_id").collect()
    got = [r for r in every if r["error"] is None]
    assert len(every) == 3 and [r["http_status"] for r in got] == [200, 304] and bytes(got[0]["payload"]) == one["payload"]
