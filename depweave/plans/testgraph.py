"""The driver's star-schema tables read as repositories, so that every query has data and an SQL counterpart.

Parts are files, consecutive lines of an order are imports and calls, suppliers of
a part are its functions, orders are commits, links of web pages are external
symbols.  ``PRELUDE`` builds the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.session import spread

LANGUAGES = (("py", "py"), ("ts", "ts"), ("js", "js"), ("java", "java"), ("kt", "kotlin"), ("tsx", "tsx"))


class TestGraph:
    """Lazy tables of the model; ``one`` puts all files into a single repository, ``python`` makes all of them live Python files."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str, one: bool = False, python: bool = False):
        self.spark, self._python = spark, python
        spread(spark, sf_dir)
        self._t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self._graph = F.lit("example.com/all") if one else F.concat(F.lit("example.com/"), F.lower("p_type"))
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def parts(self) -> DataFrame:
        n = F.pmod("p_partkey", F.lit(6))
        ext = F.element_at(F.array(*[F.lit(e) for e, _ in LANGUAGES]), (n + 1).cast("int"))
        language = F.element_at(F.array(*[F.lit(x) for _, x in LANGUAGES]), (n + 1).cast("int"))
        deleted = F.pmod("p_partkey", F.lit(29)) == 0
        if self._python:
            ext, language, deleted = F.lit("py"), F.lit("py"), F.lit(False)
        path = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), ext)
        return self._once("parts", lambda: self._t("part").select(F.col("p_partkey").alias("pk"), self._graph.alias("graph_id"), path.alias("path"), language.alias("language"), deleted.alias("deleted"), F.col("p_size").cast("int").alias("size")))

    @property
    def files(self) -> DataFrame:
        null = F.lit(None).cast("string")
        latest = self._t("orders").join(self._t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("pk")), "o_orderkey").groupBy("pk").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_custkey")).alias("m"))
        author = self._t("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("last_author"))
        with_commit = latest.select("pk", F.col("m.o_custkey").alias("custkey"), F.date_format("m.o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_commit_at"), F.concat(F.lit("c"), F.col("m.o_orderkey").cast("string")).alias("last_commit_sha")).join(author, "custkey", "left")
        make = lambda: self.parts.join(with_commit, "pk", "left").select("graph_id", "path", "language", "deleted", F.coalesce("last_author", null).alias("last_author"), "last_commit_at", "last_commit_sha")
        return self._once("files", make)

    @property
    def live(self) -> DataFrame:
        return self.parts.where(~F.col("deleted")).select("graph_id", F.col("path").alias("node"))

    @property
    def repositories(self) -> DataFrame:
        make = lambda: self.parts.groupBy("graph_id").agg(F.max("pk").alias("n")).select("graph_id", F.when(F.col("n") % 2 == 0, F.col("graph_id")).alias("name"), F.concat(F.lit("https://"), "graph_id").alias("url"), F.lit("main").alias("default_branch"), F.when(F.col("n") % 3 > 0, "complete").alias("ingest_status"), F.lit(None).cast("timestamp").alias("ingested_at"))
        return self._once("repositories", make)

    def _steps(self) -> DataFrame:
        li = self._t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("pa"), F.col("l_suppkey").alias("sa"))
        b = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pb"), F.col("l_suppkey").alias("sb"))
        return a.join(b, ["l_orderkey", "l_linenumber"])

    @property
    def edges(self) -> DataFrame:
        """Distinct imports (graph_id, src, dst) between files of one repository."""
        a = self.parts.select(F.col("pk").alias("pa"), "graph_id", F.col("path").alias("src"))
        b = self.parts.select(F.col("pk").alias("pb"), "graph_id", F.col("path").alias("dst"))
        return self._once("edges", lambda: self._steps().select("pa", "pb").distinct().join(a, "pa").join(b, ["pb", "graph_id"]).select("graph_id", "src", "dst"))

    @property
    def symbol_imports(self) -> DataFrame:
        links = self._t("pages").select(F.col("page_id").alias("pk"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
        return self._once("symbol_imports", lambda: links.distinct().join(self.parts.select("pk", "graph_id", F.col("path").alias("src")), "pk").select("graph_id", "src", "dst"))

    @property
    def imports(self) -> DataFrame:
        kind = lambda df, k: df.select("graph_id", "src", F.lit(k).alias("dst_kind"), "dst")
        return kind(self.edges, "file").unionByName(kind(self.symbol_imports, "symbol"))

    @property
    def functions(self) -> DataFrame:
        pairs = self._t("lineitem").select(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk")).distinct()
        name = F.concat(F.lit("S"), F.col("sk").cast("string"))
        kind = F.element_at(F.array(F.lit("function"), F.lit("method"), F.lit("class")), (F.col("sk") % 3 + 1).cast("int"))
        start = (F.col("sk") % 200 + 1).cast("int")
        make = lambda: pairs.join(self.parts, "pk").select("graph_id", F.concat("path", F.lit("::"), name).alias("qualified_name"), name.alias("name"), kind.alias("kind"), start.alias("start_line"), (start + F.col("size")).cast("int").alias("end_line"), "path")
        return self._once("functions", make)

    @property
    def defines(self) -> DataFrame:
        return self.functions.select("graph_id", "path", "qualified_name")

    @property
    def raw_calls(self) -> DataFrame:
        """Calls by name; every tenth supplier is a name that nothing defines."""
        callee = F.concat(F.when(F.col("sb") % 10 == 0, "X").otherwise("S"), F.col("sb").cast("string"))
        null = F.lit(None).cast("string")
        make = lambda: self._steps().select("pa", "sa", "sb").distinct().join(self.parts.withColumnRenamed("pk", "pa"), "pa").select("graph_id", "path", F.concat("path", F.lit("::S"), F.col("sa").cast("string")).alias("caller"), callee.alias("callee"), null.alias("receiver"), null.alias("caller_class"))
        return self._once("raw_calls", make)

    @property
    def commit_files(self) -> DataFrame:
        return self._once("commit_files", lambda: self._t("lineitem").select(F.col("l_orderkey").alias("commit_seq"), F.col("l_partkey").alias("pk")).distinct().join(self.parts, "pk").select("graph_id", "commit_seq", "path"))

    @property
    def sources(self) -> DataFrame:
        """(graph_id, path, language, content): Python files that import ``os`` and the files of ``edges``, and define ``functions`` that make ``raw_calls``."""
        lines = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "")
        module = F.replace(F.regexp_replace("dst", r"\.py$", ""), F.lit("/"), F.lit("."))
        imports = self.edges.groupBy("graph_id", F.col("src").alias("path")).agg(lines(F.concat(F.lit("import "), module, F.lit("\n"))).alias("imports"))
        calls = self.raw_calls.groupBy("graph_id", F.col("caller").alias("qualified_name")).agg(lines(F.concat(F.lit("    "), "callee", F.lit("()\n"))).alias("body"))
        functions = self.functions.select("graph_id", "path", "qualified_name", "name").join(calls, ["graph_id", "qualified_name"], "left")
        defined = functions.groupBy("graph_id", "path").agg(lines(F.concat(F.lit("\n\ndef "), "name", F.lit("():\n"), F.coalesce("body", F.lit("    pass\n")))).alias("functions"))
        text = lambda c: F.coalesce(c, F.lit(""))
        files = self.parts.select("graph_id", "path", "language").join(imports, ["graph_id", "path"], "left").join(defined, ["graph_id", "path"], "left")
        return files.select("graph_id", "path", "language", F.concat(F.lit("import os\n"), text("imports"), text("functions")).cast("binary").alias("content"))

    def most_imported(self) -> DataFrame:
        """The seed of impact queries: each repository's file with the most importers, the least path of those."""
        n = self.edges.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count("*").alias("n"))
        first = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("n"), "node"))
        return n.withColumn("r", first).where("r = 1").select("graph_id", "node")


PRELUDE = """
parts AS (SELECT p_partkey AS pk, {graph} AS graph_id, p_size AS size, p_partkey % 29 = 0 AS deleted,
  lower(replace(p_brand, '#', '_')) || '/' || replace(p_name, ' ', '/') || '_' || p_partkey || '.' || ['py', 'ts', 'js', 'java', 'kt', 'tsx'][p_partkey % 6 + 1] AS path,
  ['py', 'ts', 'js', 'java', 'kotlin', 'tsx'][p_partkey % 6 + 1] AS language FROM part),
live AS (SELECT graph_id, path AS node FROM parts WHERE NOT deleted),
steps AS (SELECT a.l_partkey AS pa, a.l_suppkey AS sa, b.l_partkey AS pb, b.l_suppkey AS sb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
edges AS (SELECT DISTINCT a.graph_id, a.path AS src, b.path AS dst FROM steps JOIN parts a ON a.pk = pa JOIN parts b ON b.pk = pb AND b.graph_id = a.graph_id),
symbol_imports AS (SELECT DISTINCT graph_id, path AS src, dst FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages) JOIN parts ON pk = page_id),
functions AS (SELECT graph_id, path || '::S' || sk AS qualified_name, 'S' || sk AS name, ['function', 'method', 'class'][sk % 3 + 1] AS kind, CAST(sk % 200 + 1 AS INT) AS start_line,
  CAST(sk % 200 + 1 + size AS INT) AS end_line, path FROM (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem) JOIN parts USING (pk)),
raw_calls AS (SELECT DISTINCT graph_id, path, path || '::S' || sa AS caller, CASE WHEN sb % 10 = 0 THEN 'X' ELSE 'S' END || sb AS callee FROM steps JOIN parts ON pk = pa),
commit_files AS (SELECT DISTINCT graph_id, l_orderkey AS commit_seq, path FROM lineitem JOIN parts ON pk = l_partkey),
seed AS (SELECT graph_id, node FROM (SELECT graph_id, dst AS node, row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, dst) AS r FROM edges GROUP BY graph_id, dst) WHERE r = 1)
"""


def sql(body: str, one: bool = False, more: str = "", python: bool = False) -> str:
    """A query over the prelude's tables; ``more`` adds further ones."""
    graph = "'example.com/all'" if one else "'example.com/' || lower(p_type)"
    prelude = PRELUDE.replace("{graph}", graph).strip()
    if python:
        prelude = prelude.replace("p_partkey % 29 = 0 AS deleted", "false AS deleted").replace("['py', 'ts', 'js', 'java', 'kt', 'tsx'][p_partkey % 6 + 1] AS path", "'py' AS path").replace("['py', 'ts', 'js', 'java', 'kotlin', 'tsx'][p_partkey % 6 + 1] AS language", "'py' AS language")
    return "WITH RECURSIVE " + prelude + (",\n" + more.strip() if more else "") + "\n" + body.strip()
