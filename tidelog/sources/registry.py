"""Which source a configuration means, discovery of labels, and merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import SourceError
from tidelog.sources import local, remote, stores

SOURCE_LABEL = "__source__"
ALIASES = {"k8s": "kubernetes", "es": "elasticsearch", "opensearch": "elasticsearch", "cw": "cloudwatch", "pipe": "stdin"}


def detect(config: dict) -> str:
    """The kind of source: stated, else by path, url, port and region."""
    if config.get("type"):
        return ALIASES.get(config["type"].lower(), config["type"].lower())
    if config.get("path"):
        return "file"
    url = (config.get("url") or "").lower()
    if not url:
        return "demo"
    if ":9200" in url or "elastic" in url or "opensearch" in url:
        return "elasticsearch"
    if "amazonaws.com" in url or config.get("extra", {}).get("region"):
        return "cloudwatch"
    return "loki"


def _answers(spark: SparkSession, c: dict) -> DataFrame:
    return spark.read.text(c["answers"], wholetext=True)


def _store(read, spark: SparkSession, kind: str, c: dict) -> DataFrame:
    """What a live store sends as log rows; ``read`` is a reader of batches or streams."""
    stores.register(spark)
    options = {k: str(v) for k, v in (c | c.get("extra", {})).items() if k not in ("extra", "type")}
    got = read.format("log_store").options(kind=kind, **options).load()
    if kind == "elasticsearch":
        return remote.elastic_hits(got, order="seq")
    if kind == "cloudwatch":
        return remote.cloudwatch_events(got, c.get("log_group", ""), order="seq")
    if kind in ("file", "command", "docker", "kubernetes"):
        name = F.element_at(F.split("path", "/"), -1) if kind == "file" else F.col("path")
        label = {"file": "filename", "command": "service", "docker": "container", "kubernetes": "pod"}[kind]
        guess = kind if kind in ("file", "command") else "container"
        labels = F.create_map(F.lit("source"), F.lit(kind), F.lit(label), F.split_part(name, F.lit(" "), F.lit(1)), F.lit("level"), local.guess_level(F.col("line"), guess))
        return got.select("seq", F.current_timestamp().alias("ts"), labels.alias("labels"), "line", F.lit(None).cast("string").alias("raw"))
    return got


READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "demo": lambda s, c: local.demo(s, c.get("limit", 100)),
    "file": lambda s, c: local.read_files(s, c["path"], c.get("limit")),
    "command": lambda s, c: local.read_command(s, c["command"], c.get("limit", 1000), allow=c.get("allow", False)),
    "docker": lambda s, c: local.read_docker(s, c["container"], c.get("limit", 1000), allow=c.get("allow", False)),
    "kubernetes": lambda s, c: local.read_kubernetes(s, c.get("pod", ""), c.get("selector", ""), c.get("namespace", "default"), c.get("limit", 1000), allow=c.get("allow", False)),
    "stdin": lambda s, c: local.from_lines(s, c["lines"], {"source": "stdin"}, limit=c.get("limit")),
    "loki": lambda s, c: remote.loki_rows(_answers(s, c)) if "answers" in c else _store(s.read, s, "loki", c),
    "elasticsearch": lambda s, c: remote.elastic_rows(_answers(s, c)) if "answers" in c else _store(s.read, s, "elasticsearch", c),
    "cloudwatch": lambda s, c: remote.cloudwatch_rows(_answers(s, c), c.get("log_group", ""), c.get("limit")) if "answers" in c else _store(s.read, s, "cloudwatch", c),
}


def open_source(spark: SparkSession, config: dict) -> DataFrame:
    kind = detect(config)
    if kind not in READERS:
        raise SourceError(f"unknown source type {kind!r}")
    return READERS[kind](spark, config)


def tail(spark: SparkSession, config: dict) -> DataFrame:
    """New rows of a source as a stream: the three stores, files, and with
    ``allow`` commands, containers and pods."""
    kind = detect(config)
    if kind not in stores.KINDS:
        raise SourceError(f"{kind!r} can't be followed")
    return _store(spark.readStream, spark, kind, config)


def merge_tails(children: dict[str, DataFrame]) -> DataFrame:
    """Streams of several sources as one, each row tagged by its source."""
    return reduce(DataFrame.unionByName, [_tagged(df, name) for name, df in children.items()])


def _tagged(df: DataFrame, name: str) -> DataFrame:
    tag = F.create_map(F.lit(SOURCE_LABEL), F.lit(name))
    return df.select("seq", "ts", F.map_concat(F.map_filter("labels", lambda k, v: k != SOURCE_LABEL), tag).alias("labels"), "line", "raw")


def client(config: dict):
    """The live store a configuration means."""
    kind = detect(config)
    if kind not in ("loki", "elasticsearch", "cloudwatch"):
        raise SourceError(f"{kind!r} has no labels to ask for")
    return stores.KINDS[kind](config | config.get("extra", {}))


def store_labels(spark: SparkSession, config: dict) -> DataFrame:
    """Label names that a live store tells."""
    return spark.createDataFrame([(x,) for x in client(config).labels()], "name string")


def store_values(spark: SparkSession, config: dict, name: str) -> DataFrame:
    """Values of a label that a live store tells."""
    return spark.createDataFrame([(x,) for x in client(config).values(name)], "value string")


def check(config: dict) -> bool:
    """Whether a live store answers and is well; other sources are."""
    if detect(config) not in ("loki", "elasticsearch", "cloudwatch"):
        return True
    try:
        client(config).health()
    except SourceError:
        return False
    return True


def label_names(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.map_keys("labels")).alias("name")).distinct()


def label_values(df: DataFrame, name: str, top: int | None = None) -> DataFrame:
    """Values of a label with their counts; the ``top`` most frequent ones."""
    g = df.where(F.col("labels")[name].isNotNull()).groupBy(F.col("labels")[name].alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "value").limit(top) if top else g


def merge(children: dict[str, DataFrame | Callable[[], DataFrame]], limit: int | None = None) -> DataFrame:
    """Rows of several sources, oldest first, tagged by source. Children that
    can't be opened are skipped; if none can, an error says so."""
    parts, failed = [], []
    for k, (name, child) in enumerate(children.items()):
        try:
            df = child() if callable(child) else child
        except SourceError as e:
            failed.append(f"{name}: {e}")
            continue
        parts.append(_tagged(df, name).withColumn("_k", F.lit(k)))
    if not parts:
        raise SourceError("no source answered: " + "; ".join(failed))
    both = reduce(DataFrame.unionByName, parts).orderBy("ts", "_k", "seq")
    return (both.limit(limit) if limit is not None else both).drop("_k")


def merged_labels(dfs: list[DataFrame]) -> DataFrame:
    names = reduce(DataFrame.unionByName, [label_names(d) for d in dfs])
    tag = names.sparkSession.createDataFrame([(SOURCE_LABEL,)], "name string")
    return names.unionByName(tag).distinct().orderBy("name")


def healthy(answers: list[bool]) -> bool:
    """A merged source is healthy if any child is."""
    return any(answers)
