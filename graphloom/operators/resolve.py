"""Entity resolution: unresolved edge targets, tests by direct calls, docs by title, generated symbols by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.relations import last_segment, symbol_by_qualified_name
from graphloom.shared import cut, spread, stored

#: Kinds that may be resolved by a simple name.
BY_NAME = ("Calls", "ReferencesType", "ModifiedWith", "ConfiguredBy", "TestedBy", "Spawns", "SendsTo", "Extends", "Implements")
NOT_MODULE = ("ReferencesType", "Calls", "Extends", "Implements")


def simple_name(target: Column) -> Column:
    """Without ``self.``, or what follows the last ``.``, else the last ``::``, else all."""
    return (
        F.when(target.startswith("self."), F.substring(target, 6, 1 << 30))
        .when(target.contains("."), F.regexp_extract(target, r"([^.]*)$", 1))
        .otherwise(F.regexp_extract(target, r"((?:(?!::).)*)$", 1))
    )


def dotted(target: Column) -> Column:
    """The last ``.`` as ``::``."""
    return F.when(target.contains("."), F.regexp_replace(target, r"\.([^.]*)$", "::$1"))


def unique_names(g) -> DataFrame:
    """Simple names that one symbol of a repository has, with and without modules counted. ``n`` other than 1 is ambiguous."""
    rows = g.symbols.join(g.files.select(F.col("id").alias("file"), "repository_id"), F.col("file_id") == F.col("file"))
    return rows.groupBy("repository_id", "name").agg(
        F.count(F.lit(1)).alias("n_all"), F.min("id").alias("id_all"),
        F.count(F.when(F.col("kind") != "Module", 1)).alias("n_plain"), F.min(F.when(F.col("kind") != "Module", F.col("id"))).alias("id_plain"),
    )


def resolve_edges(g) -> DataFrame:
    """Each unresolved edge with the symbol that it resolves to (or none) and the stage that found it.

    Stages: ``exact`` qualified name, ``dotted`` (last dot as ``::``), ``unique`` simple name in the source's repository. All
    are left joins on equal keys; ambiguity is decided on counts per name, never on gathered candidates. Each distinct target is looked up
    once and its edges take what was found. Symbols may be many however small Spark takes the table behind them to be (a few bytes of
    a table can be a whole file), so none of these joins may broadcast them.
    """
    home = g.symbols.join(g.files.select(F.col("id").alias("file"), "repository_id"), F.col("file_id") == F.col("file")).select(F.col("id").alias("source_symbol_id"), "repository_id")
    edges = g.edges.filter("target_symbol_id is null and unresolved_target is not null").join(home.hint("merge"), "source_symbol_id")
    by_name = symbol_by_qualified_name(g).select("repository_id", F.col("qualified_name").alias("q"), F.col("id").alias("found"))
    target = F.col("unresolved_target")
    # A target without a dot is tried by itself again, which finds nothing new: rows with a null key would all meet in one task.
    names = edges.select("repository_id", "unresolved_target").distinct().withColumns({"dotted": F.coalesce(dotted(target), target), "simple": simple_name(target)})
    exact = by_name.withColumnsRenamed({"q": "unresolved_target", "found": "exact_id"})
    second = by_name.withColumnsRenamed({"q": "dotted", "found": "dotted_id"})
    names = names.join(exact.hint("merge"), ["repository_id", "unresolved_target"], "left").join(second.hint("merge"), ["repository_id", "dotted"], "left")
    names = names.join(unique_names(g).withColumnRenamed("name", "simple").hint("merge"), ["repository_id", "simple"], "left")
    edges = edges.join(names.hint("merge"), ["repository_id", "unresolved_target"], "left")
    may = F.col("kind").isin(*BY_NAME) & ~((F.col("kind") == "ModifiedWith") & (target.contains(".") | target.contains("::"))) & (F.col("simple") != "*")
    unique = F.when(F.col("kind").isin(*NOT_MODULE), F.when(F.col("n_plain") == 1, F.col("id_plain"))).otherwise(F.when(F.col("n_all") == 1, F.col("id_all")))
    edges = edges.withColumn("unique_id", F.when(may, unique))
    stage = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("dotted_id").isNotNull(), "dotted").when(F.col("unique_id").isNotNull(), "unique").otherwise("none")
    return edges.select("source_symbol_id", "kind", "unresolved_target", F.coalesce("exact_id", "dotted_id", "unique_id").alias("resolved_id"), stage.alias("stage"), "repository_id", *[c for c in ("confidence", "ordering") if c in edges.columns])


def resolve_external(edges: DataFrame, owners: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges still without target whose first segment is a dependency of the source's package: ``external:<segment>``.

    ``owners``: source_symbol_id, package_id; ``dependencies``: package_id, name.
    """
    first = F.when(F.col("unresolved_target").contains("::"), F.substring_index("unresolved_target", "::", 1)).otherwise(F.substring_index("unresolved_target", ".", 1))
    return edges.filter("stage = 'none'").withColumn("name", first).join(owners, "source_symbol_id").join(dependencies.select("package_id", "name").distinct(), ["package_id", "name"]).select("source_symbol_id", "kind", "unresolved_target", F.concat(F.lit("external:"), "name").alias("external_file"))


class _Tables:
    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)


#: What tells edges apart before they are resolved.
EDGE = ["source_symbol_id", "kind", "unresolved_target"]


def _keys(edges: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the edges, once for each name by which they may be resolved: ``q`` qualified, ``n`` simple."""
    target = F.col("unresolved_target")
    tries = F.filter(F.array(F.struct(F.lit("q").alias("sort"), target.alias("key")), F.struct(F.lit("q").alias("sort"), dotted(target).alias("key")), F.struct(F.lit("n").alias("sort"), simple_name(target).alias("key"))), lambda x: x["key"].isNotNull())
    return edges.select(*columns, F.inline(tries))


def _names(symbols: DataFrame) -> DataFrame:
    """The names of symbols as keys."""
    return symbols.select(F.inline(F.array(F.struct(F.lit("q").alias("sort"), F.col("qualified_name").alias("key")), F.struct(F.lit("n").alias("sort"), F.col("name").alias("key"))))).distinct()


def _named(symbols: DataFrame, keys: DataFrame) -> DataFrame:
    """Symbols that one of the keys may mean: all others neither match nor make a name ambiguous."""
    q, n = (keys.filter(F.col("sort") == k).select(F.col("key").alias(c)).distinct() for k, c in (("q", "qualified_name"), ("n", "name")))
    by_name = symbols.join(n, "name", "left_semi").select(symbols.columns)
    return by_name.unionByName(symbols.join(q, "qualified_name", "left_semi").join(n, "name", "left_anti").select(symbols.columns))


def resolve_among(g, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``resolve_edges`` of a few edges: of the symbols, their sources and those of their names are gone through, not all."""
    keys = cut(_keys(edges.select("unresolved_target").distinct()).distinct())
    need = _named(symbols, keys).unionByName(symbols.join(edges.select(F.col("source_symbol_id").alias("id")).distinct().hint("merge"), "id", "left_semi").select(symbols.columns)).distinct()
    # A source that is there for itself has all symbols of its own name beside it only if that is a key; other names aren't asked for.
    return resolve_edges(_Tables(files=g.files, symbols=need, edges=edges))


def resolve_fixpoint(g, owners: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All edges as ``resolve_edges`` gives them, and the symbols made on the way, once nothing more can be resolved.

    What stays open after the first three stages and begins with a dependency of the source's package gets a symbol in the file
    ``external:<dependency>`` (stage ``external``), whose names are then tried by the edges that are still open: by those alone whose names
    the new symbols bear, round after round, until none is left. An edge that is resolved stays as it is.

    ``owners`` and ``dependencies`` as in ``resolve_external``. Made symbols: repository_id, external_file, id, file_id, name, qualified_name, kind.
    """
    columns = ["id", "file_id", "name", "qualified_name", "kind"]
    symbols, files = g.symbols.select(*columns), g.files.select("id", "repository_id", "language", "path")
    tried = cut(resolve_edges(_Tables(files=files, symbols=symbols, edges=g.edges)))
    done, left = tried.filter("stage <> 'none'"), tried.filter("stage = 'none'")
    outside = resolve_external(left, owners, dependencies).distinct()
    found = cut(left.join(outside, EDGE).withColumn("file_id", F.xxhash64("repository_id", "external_file")).withColumn("resolved_id", F.xxhash64("file_id", "unresolved_target")).withColumn("stage", F.lit("external")))
    made = cut(found.select("repository_id", "external_file", F.col("resolved_id").alias("id"), "file_id", last_segment(F.col("unresolved_target")).alias("name"), F.col("unresolved_target").alias("qualified_name"), F.lit("Unknown").alias("kind")).distinct())
    out = done.unionByName(found.select(tried.columns))
    left = cut(left.join(found.select(EDGE).distinct(), EDGE, "left_anti").select(tried.columns))
    symbols = symbols.unionByName(made.select(*columns))
    files = files.unionByName(made.select(F.col("file_id").alias("id"), "repository_id", F.lit("rust").alias("language"), F.col("external_file").alias("path")).distinct())
    fresh = made
    while True:
        names = _names(fresh)
        hit = _keys(left, *EDGE).join(names, ["sort", "key"], "left_semi").select(EDGE).distinct()
        delta = cut(left.join(hit, EDGE, "left_semi").select(*EDGE, F.lit(None).cast("long").alias("target_symbol_id"), *[c for c in ("confidence", "ordering") if c in left.columns]))
        if delta.isEmpty():
            return out.unionByName(left), made
        again = cut(resolve_among(_Tables(files=files), delta, symbols).filter("stage <> 'none'").select(tried.columns))
        out = out.unionByName(again)
        left = cut(left.join(again.select(EDGE), EDGE, "left_anti").select(tried.columns))
        fresh = fresh.limit(0)  # these rules make no symbols after the first round; a rule that does would put them here


def resolve_changed(g, before: DataFrame, edges_before: DataFrame, symbols_before: DataFrame) -> DataFrame:
    """``resolve_edges(g)`` from what it gave before: only edges that are new or bear a changed name are resolved again.

    ``before`` is the old result, ``edges_before`` and ``symbols_before`` what it was made of. A symbol counts as changed if its row did;
    then its old and new names are. Whether a name is ambiguous is told from the symbols of that name, so the others aren't read
    again; the work goes with the names that changed and the edges that bear them.

    Old results and new edges meet in one shuffle by source and are written once, as Parquet under the checkpoint folder; ``edges_before`` isn't
    read, as an edge without old result is resolved in any case. Names are told by a bounded sieve: an edge that it takes for changed by mistake is resolved again to the same.
    """
    columns = ["id", "file_id", "name", "qualified_name", "kind"]
    sides = g.symbols.select(*columns, F.lit(1).alias("n")).unionByName(symbols_before.select(*columns, F.lit(-1).alias("n")))
    changed = cut(sides.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0"))
    # Sources that came or went, or moved to another repository, take their edges with them.
    moved = changed.groupBy("id", "file_id").agg(F.sum("n").alias("n")).filter("n <> 0").select(F.col("id").alias("source_symbol_id"), F.lit(True).alias("moved")).distinct()
    number = lambda sort, key: F.pmod(F.xxhash64(sort, key), F.lit(HEADS)).cast("int")
    sieve = cut(_names(changed.select(*columns)).select(number(F.col("sort"), F.col("key")).alias("number")).distinct())
    rows = g.edges.filter("target_symbol_id is null and unresolved_target is not null")
    fresh = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(before.schema[c].dataType).alias(c) for c in before.columns], F.lit(True).alias("now"))
    both = before.withColumn("now", F.lit(False)).unionByName(fresh).repartition("source_symbol_id").join(moved.hint("merge"), "source_symbol_id", "left")
    edge = Window.partitionBy(*EDGE)
    both = both.withColumns({"still": F.max("now").over(edge), "since": ~F.min("now").over(edge)}).filter("now or still")
    target, named = F.col("unresolved_target"), F.lit(False)
    for k, (sort, key) in enumerate((("q", target), ("q", dotted(target)), ("n", simple_name(target)))):
        both = both.join(F.broadcast(sieve.withColumnRenamed("number", f"number{k}")), number(F.lit(sort), key) == F.col(f"number{k}"), "left")
        named = named | F.col(f"number{k}").isNotNull()
    again = named | F.coalesce("moved", F.lit(False)) | ~F.col("since")
    both = stored(both.withColumn("again", again).filter("now = again").select(*before.columns, "again"))
    edges = both.filter("again").select(*EDGE, F.lit(None).cast("long").alias("target_symbol_id"), *[c for c in ("confidence", "ordering") if c in before.columns])
    return both.filter("not again").select(before.columns).unionByName(resolve_among(g, edges, g.symbols.select(*columns)).select(before.columns))


def write_back(g, resolved: DataFrame) -> DataFrame:
    """All edges after resolution, one a source, target and kind: an edge that was resolved before goes first."""
    before = g.edges.filter("target_symbol_id is not null").select("source_symbol_id", "target_symbol_id", "kind", F.lit(0).alias("late"))
    now = resolved.filter("resolved_id is not null").select("source_symbol_id", F.col("resolved_id").alias("target_symbol_id"), "kind", F.lit(1).alias("late"))
    return before.unionByName(now).groupBy("source_symbol_id", "target_symbol_id", "kind").agg(F.min("late").alias("late"))


def direct_call_tests(g) -> DataFrame:
    """Test -> production links: resolved calls of tests to what isn't a test."""
    tests = g.tests.select(F.col("id").alias("test_id"))
    calls = g.edges.filter("kind = 'Calls' and target_symbol_id is not null").select("source_symbol_id", "target_symbol_id")
    calls = calls.join(tests, calls.source_symbol_id == tests.test_id, "left_semi")
    return calls.join(tests, calls.target_symbol_id == tests.test_id, "left_anti").distinct()


def normalise(name: Column) -> Column:
    """Lower case, spaces and dashes as ``_``, of the rest only letters, digits and ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[ \-]", "_"), r"[^\p{L}\p{N}_]", "")


def _titles(g) -> DataFrame:
    return g.docs.filter("title is not null").select(F.col("id").alias("doc_id"), normalise(F.col("title")).alias("key"))


def _names_of_symbols(g) -> DataFrame:
    return g.symbols.select(F.col("id").alias("symbol_id"), normalise(F.col("name")).alias("key"))


def doc_symbol_links(g) -> DataFrame:
    """Docs and symbols whose normalised title and name are equal: an equi-join on the normal form."""
    return _titles(g).join(_names_of_symbols(g), "key").select("doc_id", "symbol_id").distinct()


def doc_symbol_counts(g) -> DataFrame:
    """``doc_id, n_symbols, first_symbol``: how many symbols ``doc_symbol_links`` links each doc with, and the least of them, without making the pairs.

    Docs with the same normalised titles (one, but for ids that several rows have) have the same symbols, which are counted once for all of them.
    """
    docs = _titles(g).groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    titles = docs.select("keys").distinct().select("keys", F.explode("keys").alias("key"))
    linked = titles.join(_names_of_symbols(g), "key").select("keys", "symbol_id").distinct()
    found = linked.groupBy("keys").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("symbol_id").alias("first_symbol"))
    return docs.join(found, "keys").select("doc_id", "n_symbols", "first_symbol")


#: Characters of the beginnings by which names are looked for first. Shorter names are looked for whole.
GRAM = 5
#: Numbers of the sieves over names' beginnings and heads: what is broadcast is small integers, at most this many for each size of a head.
SIEVE, HEADS = 1 << 18, 1 << 20


def _stretch(chars: str, at: Column, size: Column) -> Column:
    """``size`` characters of an array of them from ``at`` (from 1), fewer at its end."""
    return F.array_join(F.slice(chars, at, size), "")


def _like_names(source: DataFrame, names: DataFrame, gram: int) -> DataFrame | None:
    """``id, name``: the distinct stretches of texts (``id, text``) that have the head and the length of one of the names; none without names.

    A name's head is its first ``gram`` characters, or twice, four times, … as many: the most that it has, so more than half of it. Names shorter
    than ``gram`` are heads themselves. At each place of a text the next ``gram`` characters go through a sieve of names' beginnings, what passes
    is tried by the sizes of the heads that begin so and goes through a sieve of heads, and what is left meets the distinct heads by an
    equi-join, which tells the lengths. All that goes with the texts and the sizes and lengths of names, not with the number of names that have a piece in common.
    """
    length = F.char_length("name")
    size = F.when(length < gram, length).otherwise(F.expr(f"shiftleft({gram}, length(bin(char_length(name) div {gram})) - 1)"))
    heads = cut(names.select(F.substr("name", F.lit(1), size).alias("head"), length.alias("length")).distinct())
    size = F.char_length("head")
    sizes = [r["size"] for r in heads.select(F.least(size, F.lit(gram)).alias("size")).distinct().collect()]  # at most ``gram`` numbers
    if not sizes:
        return None
    # Hashes pass over nulls, so that beyond the end of a text or head there is the hash of what is there.
    begin = lambda at, k: F.pmod(F.xxhash64(*(F.get("chars", at + i) for i in range(k))), F.lit(SIEVE)).cast("int")
    number = F.pmod(F.xxhash64("head"), F.lit(HEADS)).cast("int")
    begins = heads.select(F.split("head", "").alias("chars"), size.alias("size")).select(begin(F.lit(0), gram).alias("begin"), "size").distinct()
    # Dealt over the cores, as a few row groups may hold all texts; the outer form doesn't split texts once more to ask whether they are empty.
    places = spread(source).select("id", F.split("text", "").alias("chars")).select("id", "chars", F.posexplode_outer("chars").alias("at", "char"))
    places = places.select("id", "chars", "at", F.explode(F.array(*(begin(F.col("at"), k) for k in sizes))).alias("begin") if len(sizes) > 1 else begin(F.col("at"), sizes[0]).alias("begin"))
    at, size = F.col("at") + 1, F.col("size")
    hits = places.join(F.broadcast(begins), "begin").filter(F.col("at") + size <= F.size("chars"))
    hits = hits.select("id", _stretch("chars", at, size).alias("head"), F.when(size < gram, "").otherwise(_stretch("chars", at + size, size - 1)).alias("tail"))
    hits = hits.join(F.broadcast(heads.select(number.alias("number")).distinct()), number == F.col("number"), "left_semi").distinct()
    more = F.col("length") - F.char_length("head")
    found = hits.join(heads.hint("merge"), "head").filter(more <= F.char_length("tail"))
    return found.select("id", F.concat("head", F.substr("tail", F.lit(1), more)).alias("name")).distinct()


def _texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")


def names_in_texts(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, gram: int = GRAM) -> DataFrame:
    """``id, name``: each distinct name that a text contains anywhere. Null texts and empty names match nothing.

    Stretches of texts that have the head and the length of a name meet the names by an equi-join, which is exact. No name and no text passes the driver.
    """
    source, names = _texts(texts, id_col, text_col), names.select(F.col(names.columns[0]).cast("string").alias("name")).filter("name <> ''")
    like = _like_names(source, names, gram)
    return source.select("id", F.lit("").alias("name")).limit(0) if like is None else like.join(names.hint("merge"), "name", "left_semi").select("id", "name")


def doc_body_links(g, symbols: DataFrame | None = None, gram: int = GRAM, block_chars: int | None = None) -> DataFrame:
    """Docs whose body contains a symbol's qualified name, with ``::`` or with dots; of all symbols if none are given.

    ``block_chars`` has no effect any more: names don't come in blocks.
    """
    symbols = g.symbols if symbols is None else symbols
    dots = F.replace(F.col("qualified_name"), F.lit("::"), F.lit("."))
    names = symbols.select(F.col("id").alias("symbol_id"), F.explode(F.array_distinct(F.array(F.col("qualified_name"), dots))).alias("name")).filter("name <> ''")
    source = _texts(g.docs, "id", "body")
    like = _like_names(source, names, gram)
    like = source.select("id", F.lit("").alias("name")).limit(0) if like is None else like
    return like.join(names, "name").select(F.col("id").alias("doc_id"), "symbol_id").distinct()


def generated_base(name: Column) -> Column:
    """``struct(base name, annotation, edge kind)`` that a generated symbol's name points to, by suffix or prefix."""
    rule = lambda base, mark, kind: F.struct(base.alias("base"), F.lit(mark).alias("mark"), F.lit(kind).alias("kind"))
    cut = lambda n: F.expr(f"substring(name, 1, length(name) - {n})")
    return (
        F.when(name.endswith("Serializer"), rule(cut(10), "Serializable", "ConfiguredBy"))
        .when(name.endswith("_Impl"), rule(cut(5), "Dao", "Implements"))
        .when(name.endswith("JsonAdapter"), rule(cut(11), "JsonClass", "ConfiguredBy"))
        .when(name.startswith("Dagger"), rule(F.expr("substring(name, 7)"), "Component", "Implements"))
    )


def generated_links(symbols: DataFrame, annotations: DataFrame) -> DataFrame:
    """Generated symbol -> base symbol, where the base carries the annotation. ``annotations``: symbol_id, mark."""
    made = symbols.select(F.col("id").alias("generated_id"), generated_base(F.col("name")).alias("r")).filter("r is not null").select("generated_id", "r.*")
    base = symbols.select(F.col("id").alias("base_id"), F.col("name").alias("base"))
    return made.join(base, "base").join(annotations.select(F.col("symbol_id").alias("base_id"), "mark"), ["base_id", "mark"], "left_semi").select("generated_id", "base_id", "kind")
