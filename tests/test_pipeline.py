import pytest

from tidelog.functions import rx
from tidelog.model import labels_text, row_index, running_sum, with_previous
from tidelog.plans import compiler, lang, nl
from pyspark.sql import functions as F


def lines(df):
    return [r.line for r in df.orderBy("seq").collect()]


def test_parse():
    assert lang.parse('{} | json | status!="200" | method=~"GET|POST"')[1] == [lang.Word("json"), lang.LabelFilter("status", "!=", "200"), lang.LabelFilter("method", "=~", "GET|POST")]
    assert lang.parse('{} |= "error" != "timeout"')[1] == [lang.LineFilter("error"), lang.LineFilter("timeout", negated=True)]
    assert lang.parse("") == ("", []) and lang.parse('{job="api"}') == ('{job="api"}', [])
    for bad in ('{} |="x"', '{} | status != "200"', "{} | duration>1000", "{} | sample 0"):
        with pytest.raises(lang.PipelineError):
            lang.parse(bad, strict=True)
    assert lang.parse('{} |="x"')[1] == [lang.LineFilter("x")]
    assert lang.unquote(r'"a\d\"b"') == 'ad"b'
    assert lang.balanced("{a}") and not lang.balanced("}{") and not lang.balanced("{")
    assert lang.build_selector([("a", "b"), ("c", 'd"')], escape=True) == '{a="b", c="d\\""}'


def test_english():
    assert nl.translate("errors from api service in the last hour") == '{job="api"} |= "error"'
    assert nl.translate("show me all warnings containing timeout") == '{job="gs"} | json |= "warn" |= "timeout" | duration>1000'
    assert nl.translate("slow requests over 2 seconds") == "{} | json | duration>2000"
    assert nl.translate("500 errors from payment service") == '{job="payment"} |= "error" |= "500"'


def test_stages(log_rows):
    js = log_rows(['{"msg":"disk full","level":"error","host":"a","n":1.50}', '{"msg":"disk full","level":"error","host":"a"}', '{"level":"info"}', "plain", None, '[1]', '{"a":1} x'])
    out = compiler.run(js, '{} | json | level="error" | label_drop host | dedup').orderBy("seq").collect()
    assert [(r.seq, r.labels["msg"]) for r in out] == [(0, "disk full"), (1, "disk full")] and "host" not in out[0].labels
    assert lines(compiler.run(log_rows(["hello", "hello", "world", "world", "hello"]), "{} | dedup")) == ["hello", "world", "hello"]
    assert lines(compiler.run(log_rows([f"line{i}" for i in range(20)]), "{} | sample 5 | limit 2")) == ["line0", "line5"]
    kv = compiler.run(log_rows(['level=error msg="connection \\"failed\\"" x= =a=b duration=42ms level=warn']), "{} | logfmt")
    assert kv.select(labels_text(F.col("labels"))).collect()[0][0] == 'duration=42ms;level=warn;msg=connection "failed";x='
    un = compiler.run(log_rows(['{"msg":"hello","meta":{"region":"us","dc":{"id":1}},"z":null,"l":[1,2]}', "plain"]), "{} | unpack").orderBy("seq").collect()
    assert un[0].labels == {"msg": "hello", "meta.region": "us", "meta.dc.id": "1", "l": "[1,2]"} and un[1].labels == {}
    fm = compiler.run(log_rows([("x", {"level": "info", "msg": "hello world"})]), '{} | line_format "{{.level}}: {{ .msg }} {{.no}}"')
    assert lines(fm) == ["info: hello world {{.no}}"]
    rg = compiler.run(log_rows(["192.168.1.1 GET /api/health 200 12ms"]), r'{} | regex `(?P<ip>\S+) (?P<method>\w+) (?P<path>\S+) (?P<status>\d+)`').collect()[0].labels
    assert rg == {"ip": "192.168.1.1", "method": "GET", "path": "/api/health", "status": "200"}


def test_invalid_regexes(log_rows):
    rows = log_rows([("a [ b", {"x": "1"}), ("c", {})])
    assert lines(compiler.run(rows, '{} |~ "["')) == ["a [ b"]
    assert compiler.run(rows, '{} | x=~"["').count() == 0 and compiler.run(rows, '{} | x!~"["').count() == 2
    assert compiler.run(rows, '{} | regex "["').count() == 2
    assert compiler.run(rows, '{} | x=""').count() == 1 and compiler.run(rows, '{} | x!="a"').count() == 2
    assert rx.to_java("(?=a)") is None and rx.to_java(r"(?P<a_b>x)(y)(?P<c>z)").names == (("a_b", 1), ("c", 3))


def test_numeric_extension_and_selector(log_rows):
    rows = log_rows([("x", {"duration": "1500", "app": "web"}), ("y", {"duration": "5"}), ("z", {"duration": "n/a", "app": "webs"})])
    assert lines(compiler.run(rows, "{} | duration>1000")) == ["x"]
    assert lines(compiler.run(rows, '{app=~"web"}')) == ["x"]


def test_order_helpers_over_small_blocks(spark):
    ids = [3, 9, 10, 11, 25, 40, 41]
    df = spark.createDataFrame([(i,) for i in ids], "seq bigint")
    assert {r.seq: r.idx for r in row_index(df, block=10).collect()} == {x: k for k, x in enumerate(ids)}
    prev = {r.seq: r.p for r in with_previous(df, {"seq": "p"}, block=10).collect()}
    assert prev == dict(zip(ids, [None, *ids[:-1]]))
    run = {r.seq: r.s for r in running_sum(df, F.lit(1), "s", block=10).collect()}
    assert run == {x: k + 1 for k, x in enumerate(ids)}
    assert row_index(df.limit(0)).count() == 0


def test_filters_move_before_parsing():
    s = lang.parse('{} | json | json | a="b" |= "x" | line_format "y" |= "z"')[1]
    moved = compiler.push_filters(s)
    assert moved[0] == lang.LineFilter("x") and moved[-1] == lang.LineFilter("z") and moved.count(lang.Word("json")) == 1


def test_regexes_cover_all_scripts(log_rows):
    rows = log_rows(["größe 5", "size 5", "x=7", "日本 1"])
    got = lambda q: [r.line for r in compiler.run(rows, q).orderBy("seq").collect()]
    assert got(r"{} |~ `^\w+ \d$`") == ["größe 5", "size 5", "日本 1"]
    assert got(r"{} |~ `^\p{L}+ `") == ["größe 5", "size 5", "日本 1"]
    assert got(r"{} |~ `^[[:alpha:]]+=[[:digit:]]`") == ["x=7"]
    assert got(r"{} |~ `(?i)GRÖSSE|GRÖßE`") == ["größe 5"]


def test_groups_that_took_part_with_nothing_are_labels(log_rows):
    rows = log_rows(["a=,b", "a=1,b", "c"])
    got = {r.line: r.labels for r in compiler.run(rows, r"{} | regex `a=(?P<v>\d*),(?P<w>b)|(?P<z>c)`").collect()}
    assert got == {"a=,b": {"v": "", "w": "b"}, "a=1,b": {"v": "1", "w": "b"}, "c": {"z": "c"}}
