"""The star schema seen as a repository knowledge graph: every fact table as a lazy DataFrame over the Parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NATION, SUPPLIER, CUSTOMER, PART = 1_000_000, 2_000_000, 3_000_000, 4_000_000


class StarGraph:
    """Fact tables by name; nothing is read before a query runs, and then only the columns that it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def repositories(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("root_path"), F.lit("git").alias("vcs_type"))

    @cached_property
    def files(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("repository_id"),
            F.concat(F.lit("src/"), "n_name", F.lit(".py")).alias("path"), F.lit("python").alias("language"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        nation, key = self.table("nation"), lambda base, c: (F.lit(base) + F.col(c)).cast("long")
        names = nation.select("n_nationkey", "n_name")

        def of(df: DataFrame, base: int, k: str, name: str, home: str, kind: str) -> DataFrame:
            df = df.join(names, F.col(home) == F.col("n_nationkey"))
            return df.select(key(base, k).alias("id"), F.col(home).cast("long").alias("file_id"), F.col(name).alias("name"), F.concat("n_name", F.lit("::"), name).alias("qualified_name"), F.lit(kind).alias("kind"), F.col(k).cast("long").alias("start_line"))

        modules = nation.select(key(NATION, "n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("file_id"), F.col("n_name").alias("name"), F.col("n_name").alias("qualified_name"), F.lit("Module").alias("kind"), F.lit(0).cast("long").alias("start_line"))
        parts = self.table("part").select(
            key(PART, "p_partkey").alias("id"), (F.col("p_partkey") % 25).cast("long").alias("file_id"), F.col("p_name").alias("name"),
            F.concat("p_brand", F.lit("::"), "p_name", F.lit("."), F.col("p_partkey").cast("string")).alias("qualified_name"), F.lit("Method").alias("kind"), F.col("p_partkey").cast("long").alias("start_line"),
        )
        out = modules.unionByName(of(self.table("supplier"), SUPPLIER, "s_suppkey", "s_name", "s_nationkey", "Class"))
        out = out.unionByName(of(self.table("customer"), CUSTOMER, "c_custkey", "c_name", "c_nationkey", "Function")).unionByName(parts)
        return out.withColumn("end_line", F.col("start_line") + 9)

    @cached_property
    def edges(self) -> DataFrame:
        """One row per (source, target or unresolved target, kind)."""
        return self._edge_rows.groupBy("source_symbol_id", "target_symbol_id", "unresolved_target", "kind").agg(F.min("confidence").alias("confidence"), F.min("ordering").alias("ordering"))

    @cached_property
    def edges_by_source(self) -> DataFrame:
        """``source_symbol_id, target_symbol_id, unresolved_target, kind`` of the same edges, shuffled by their source alone, which serves joins on sources too."""
        columns = ["source_symbol_id", "target_symbol_id", "unresolved_target", "kind"]
        return self._edge_rows.select(*columns).repartition("source_symbol_id").groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).select(*columns)

    @cached_property
    def _edge_rows(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", (F.col("l_returnflag") == "R").alias("r"))
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        parts = self.table("part").select("p_partkey", F.concat("p_brand", F.lit("."), "p_name").alias("p_target"))
        nation = self.table("nation").select("n_nationkey", "n_name")
        suppliers = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat("n_name", F.lit("::"), "s_name").alias("s_target"))
        at = lambda base, c: (F.lit(base) + F.col(c)).cast("long")
        none, no_text = F.lit(None).cast("long"), F.lit(None).cast("string")
        calls = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
            at(CUSTOMER, "o_custkey").alias("source_symbol_id"), F.when(~F.col("r"), at(PART, "l_partkey")).alias("target_symbol_id"), F.when(F.col("r"), F.col("p_target")).alias("unresolved_target"),
            F.lit("Calls").alias("kind"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").cast("long").alias("ordering"),
        )
        refs = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
            at(PART, "l_partkey").alias("source_symbol_id"), F.when(~F.col("r"), at(SUPPLIER, "l_suppkey")).alias("target_symbol_id"), F.when(F.col("r"), F.col("s_target")).alias("unresolved_target"),
            F.lit("ReferencesType").alias("kind"), F.lit(1.0).alias("confidence"), none.alias("ordering"),
        )
        simple = lambda df, s, t, u, kind: df.select(s.alias("source_symbol_id"), t.alias("target_symbol_id"), u.alias("unresolved_target"), F.lit(kind).alias("kind"), F.lit(1.0).alias("confidence"), none.alias("ordering"))
        customer = self.table("customer")
        imports = simple(customer, at(CUSTOMER, "c_custkey"), at(NATION, "c_nationkey"), no_text, "Imports").unionByName(simple(self.table("supplier"), at(SUPPLIER, "s_suppkey"), at(NATION, "s_nationkey"), no_text, "Imports"))
        marks = simple(orders, at(CUSTOMER, "o_custkey"), none, F.col("o_orderpriority"), "ModifiedWith")
        fixtures = simple(customer.filter("c_mktsegment = 'BUILDING'"), at(CUSTOMER, "c_custkey"), at(NATION, "c_nationkey"), no_text, "ConfiguredBy")
        return calls.unionByName(refs).unionByName(imports).unionByName(marks).unionByName(fixtures)

    @cached_property
    def tests(self) -> DataFrame:
        kept = self.table("customer").filter("c_mktsegment = 'BUILDING'")
        own = kept.select((F.lit(CUSTOMER) + F.col("c_custkey")).cast("long").alias("id"))
        return self.symbols.filter("kind = 'Function'").join(own, "id", "left_semi").select("id", "file_id", "name", "qualified_name", F.lit("Function").alias("kind"))

    @cached_property
    def docs(self) -> DataFrame:
        """Documents as docs of the part with their number; the title is that part's name."""
        parts = self.table("part").select("p_partkey", "p_name")
        return self.table("documents").join(parts, F.col("doc_id") == F.col("p_partkey"), "left").select(
            F.col("doc_id").alias("id"), (F.col("doc_id") % 25).alias("file_id"), F.when(F.col("p_partkey").isNotNull(), F.col("doc_id") + F.lit(PART)).alias("symbol_id"),
            F.col("p_name").alias("title"), F.col("text").alias("body"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        )

    @cached_property
    def commits(self) -> DataFrame:
        customer = self.table("customer").select("c_custkey", "c_name")
        return self.table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("id"), F.col("c_name").alias("author_name"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("author_email"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("authored_date"), F.col("o_orderpriority").alias("message"),
        )

    @cached_property
    def commit_files(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("item")).distinct()

    @cached_property
    def commit_symbols(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("item")).distinct()

    @cached_property
    def coverage(self) -> DataFrame:
        """Lines of files by test suite; a line counts once a suite, with its most hits."""
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("file_id"), F.col("l_linestatus").alias("suite"), F.col("l_partkey").alias("line")).agg(F.max(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("hits"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def routes(self) -> DataFrame:
        return self.tests.select("id", "file_id", F.col("id").alias("symbol_id"), F.col("name").alias("handler_name"), "qualified_name", F.when(F.col("id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), F.lower("name")).alias("path"))

    @cached_property
    def models(self) -> DataFrame:
        return self.symbols.filter("kind in ('Class', 'Method')").select("id", "file_id", F.col("id").alias("symbol_id"), "name", "qualified_name", "start_line", "end_line")

    @cached_property
    def model_fields(self) -> DataFrame:
        """Parts that a supplier has delivered, as fields of its model."""
        part = self.table("part").select("p_partkey", "p_type", "p_size")
        rows = self.table("lineitem").select("l_suppkey", "l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
        even = F.col("p_size") % 2 == 0
        return rows.select((F.lit(SUPPLIER) + F.col("l_suppkey")).alias("model_id"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("name"), F.col("p_type").alias("type_annotation"), F.when(even, F.col("p_size").cast("string")).alias("default_value"), (~even).alias("is_required"))

    @cached_property
    def packages(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("src/"), "n_name", F.lit("/Cargo.toml")).alias("manifest_path"), F.col("n_regionkey").cast("string").alias("version"))

    @cached_property
    def dependencies(self) -> DataFrame:
        """Brands of the parts that lie in a package's file."""
        return self.table("part").groupBy((F.col("p_partkey") % 25).alias("package_id"), F.col("p_brand").alias("name")).agg(F.max("p_type").alias("version_requirement"), F.max(F.col("p_size") > 40).alias("is_workspace_dependency"))

    def _user(self) -> list:
        return [(F.col("user_id") % 25).cast("long").alias("file_id"), F.concat(F.lit("user::"), F.col("user_id").cast("string")).alias("symbol_qualified_name")]

    @cached_property
    def spawns(self) -> DataFrame:
        return self.events.filter("event_type = 'purchase'").select(*self._user(), F.col("event_type").alias("kind"), F.col("event_id").alias("line"))

    @cached_property
    def channels(self) -> DataFrame:
        rows = self.events.filter("event_type in ('view', 'click')")
        return rows.select(self._user()[1].alias("scope"), F.lit("mpsc").alias("kind"), F.get_json_object("props", "$.k").alias("identity"), F.when(F.col("event_type") == "view", "tx").otherwise("rx").alias("role"), F.col("event_id").alias("line"))

    def _unsafe(self, event_type: str, seconds: Column) -> DataFrame:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.events.filter((F.col("event_type") == event_type) & F.col("value").isNotNull()).select(*self._user(), at.alias("start_line"), (at + (seconds * 1_000_000).cast("long")).alias("end_line"), at.alias("line"))

    @cached_property
    def unsafe_blocks(self) -> DataFrame:
        return self._unsafe("error", F.lit(0.0))

    @cached_property
    def unsafe_functions(self) -> DataFrame:
        return self._unsafe("purchase", F.col("value") * 60)

    @cached_property
    def ffi_bindings(self) -> DataFrame:
        return self._unsafe("signup", F.lit(0.0))

    @cached_property
    def android_components(self) -> DataFrame:
        return self.table("customer").select(F.col("c_nationkey").cast("long").alias("file_id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"))

    @cached_property
    def android_resources(self) -> DataFrame:
        key = F.col("p_partkey").cast("string")
        return self.table("part").select((F.col("p_partkey") % 25).alias("file_id"), F.col("p_type").alias("type"), F.concat("p_name", F.lit(" "), key).alias("name"), F.concat(F.lit("R."), "p_type", F.lit("."), key).alias("qualified_name"))

    @cached_property
    def generated_symbols(self) -> DataFrame:
        return self.table("part").filter("p_size % 7 = 0").select((F.lit(PART) + F.col("p_partkey")).alias("symbol_id"), F.lit("Implements").alias("provenance"))
