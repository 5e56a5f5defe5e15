"""Module specifiers resolved to files: relative ones, path aliases and base URLs of configurations, workspace packages.

Candidates are joined by equality on whole paths, names or directories; what begins with something is spelt out as its
prefixes, so no pair of a specifier and an unrelated configuration or package is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import fits_pattern

from .chains import follow
from .storage import cut

#: What a file name may be left without.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]


def joined_path(*parts: Column) -> Column:
    """Parts of a path joined, . and .. taken out; a .. that leads above the start stays. The start itself is ''."""
    none = F.expr("cast(array() as array<string>)")

    def step(done: Column, part: Column) -> Column:
        up = F.coalesce(F.try_element_at(done, F.lit(-1)) != "..", F.lit(False))
        back = F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, F.lit("..")))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(F.concat_ws("/", *parts), "/", -1), none, step), "/")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def prefixes(path: Column) -> Column:
    """The directories that a path stands in and the path itself, '' first."""
    parts = F.split(path, "/", -1)
    return F.array_distinct(F.array_prepend(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.lit("")))


def inside(path: Column) -> Column:
    """Whether a joined path stays in the repository."""
    return ~F.regexp_like(path, F.lit(r"^([.][.](/|$)|/)"))


def module_files(bases: DataFrame, files: DataFrame, keys: list[str], base: str = "base") -> DataFrame:
    """The rows of bases (keys, base) with n, how many files the base may mean, the only one as path, and all as paths.
    A base with a known extension means itself, another one eight names. files: path, unique."""
    known = F.regexp_like(F.col(base), F.lit("[.](ts|tsx|js|jsx)$"))
    eight = F.array(*[F.concat(F.col(base), F.lit(e)) for e in EXTENSIONS], *[F.concat(F.col(base), F.lit("/index" + e)) for e in EXTENSIONS])
    names = bases.select(*keys, F.explode(F.when(known, F.array(base)).otherwise(eight)).alias("path"))
    found = names.join(files.select("path").distinct(), "path", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))  # of eight names
    rows = bases.join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.withColumn("path", F.when(F.col("n") == 1, F.element_at("paths", 1)))


def outcome(n: Column) -> Column:
    return F.when(n == 1, F.lit("resolved")).when(n > 1, F.lit("ambiguous-module")).otherwise(F.lit("module-not-found"))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, status, path) for imports (import_id, file, specifier)."""
    bases = imports.select("import_id", joined_path(directory(F.col("file")), F.col("specifier")).alias("base"))
    return module_files(bases, files, ["import_id"]).select("import_id", outcome(F.col("n")).alias("status"), "path")


def workspace_packages(manifests: DataFrame) -> DataFrame:
    """(name, root, manifest, entries) for manifests (path, name, workspaces, entries): those with a name whose folder fits a
    pattern of a manifest above them. A * stands for signs of one folder name."""
    rows = manifests.withColumn("root", directory(F.col("path")))
    owners = rows.select(F.col("path").alias("owner"), F.col("root").alias("above"), F.explode("workspaces").alias("pattern"))
    owners = owners.withColumn("pattern", joined_path(F.regexp_replace("pattern", "/$", "")))
    named = rows.filter("name is not null").select("name", "root", F.col("path").alias("manifest"), "entries", F.explode(prefixes(F.col("root"))).alias("above"))
    pairs = named.join(owners, "above").filter("manifest <> owner")
    below = F.when(F.col("above") == "", F.col("root")).otherwise(F.substring("root", F.length("above") + 2, F.length("root")))
    parts = F.transform(F.split("pattern", "[*]", -1), lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E")))
    fits = F.regexp_like(below, F.concat(F.lit("^"), F.array_join(parts, "[^/]*"), F.lit("$")))
    return pairs.filter(fits).select("name", "root", "manifest", "entries").distinct()


def resolve_workspace(imports: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, package, status, path) for the imports whose specifier is a package or lies under one: the longest name
    counts; of several manifests with it none. A bare name means the entries, without any the folder itself."""
    names = imports.select("import_id", "specifier", F.explode(prefixes(F.col("specifier"))).alias("name")).join(packages.groupBy("name").agg(F.count(F.lit(1)).alias("owners"), F.min_by(F.struct("root", "entries"), "manifest").alias("p")), "name")
    best = names.groupBy("import_id").agg(F.max_by(F.struct("name", "specifier", "owners", "p"), F.length("name")).alias("x")).select("import_id", "x.*", "x.p.*").drop("p")
    under = F.substring("specifier", F.length("name") + 2, F.length("specifier"))
    bare = F.when(F.size("entries") > 0, F.col("entries")).otherwise(F.array(F.lit("")))
    bases = best.filter("owners = 1").select("import_id", F.posexplode(F.when(under != "", F.array(under)).otherwise(bare)).alias("place", "entry"), "root")
    bases = bases.select("import_id", "place", joined_path(F.col("root"), F.col("entry")).alias("base"))
    tried = module_files(bases, files, ["import_id", "place"])
    found = tried.groupBy("import_id").agg(F.count_if(F.col("n") == 1).alias("n_one"), F.count_if(F.col("n") > 1).alias("n_more"), F.min("path").alias("path"))
    status = F.when((F.col("owners") > 1) | (F.col("n_one") > 1) | ((F.col("n_one") == 0) & (F.col("n_more") > 0)), F.lit("ambiguous-module")).when(F.col("n_one") == 1, F.lit("resolved")).otherwise(F.lit("module-not-found"))
    rows = best.join(found, "import_id", "left").withColumn("status", status)
    return rows.select("import_id", F.col("name").alias("package"), "status", F.when(F.col("status") == "resolved", F.col("path")).alias("path"))


def inherited(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Configurations (path, extends, base_url, paths) with the base URL and the paths that hold for them, and errors (path,
    message). extends: the path of another configuration, or null; own values replace those that are inherited. base_url is
    taken from the folder of the configuration that states it. Of a circle, the configuration that the least path leads to
    first is the error, and the one before it inherits nothing. Chains of any length are followed by doubling."""
    known = configs.select(F.col("path").alias("extends"))
    lost = configs.filter("extends is not null").join(known, "extends", "left_anti").select("path", F.concat(F.lit("Unsupported or missing extends target: "), "extends").alias("message"))
    own = F.when(F.col("base_url").isNotNull(), joined_path(directory(F.col("path")), F.col("base_url")))
    rows = configs.select(F.col("path").alias("node"), F.col("extends").alias("next"), own.alias("base_url"), "paths")
    circular = follow(rows.select("node", "next")).circular
    broken = cut(circular.groupBy("ring").agg(F.min_by("entry", "node").alias("entry")), "broken")
    last = circular.filter("node = entry").join(rows.select("node", "next"), "node").join(broken, "ring").filter(F.col("next") == broken["entry"]).select("node")
    rows = rows.join(last.withColumn("last", F.lit(True)), "node", "left").withColumn("next", F.when(F.col("last").isNull(), F.col("next"))).drop("last")
    held = follow(rows, ["base_url", "paths"]).ended.select(F.col("node").alias("path"), "base_url", "paths")
    return held, lost.union(broken.select("entry", F.lit("Circular configuration extends chain")))


def wrapped_declarations(declarations: DataFrame) -> DataFrame:
    """(file, name, declaration, wrappers) for declarations (file, name, wrapped): a declaration may wrap another one of its
    file by name; the last of the chain is what it declares, and wrappers counts those passed. Both are null where a chain
    leads to no declaration or round a circle."""
    key = lambda name: F.to_json(F.array("file", name))
    rows = cut(declarations.select(key("name").alias("node"), "file", "name", F.when(F.col("wrapped").isNotNull(), key("wrapped")).alias("next")), "declarations")
    ended = follow(rows.select("node", "next")).ended
    last = rows.select(F.col("node").alias("end"), F.col("name").alias("declaration"))
    found = ended.join(last, "end").select("node", "declaration", F.col("steps").alias("wrappers"))
    return rows.join(found, "node", "left").select("file", "name", "declaration", "wrappers")


def resolve_configured(imports: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, config, kind, status, path) for imports (import_id, file, specifier) that a configuration (path, base_url,
    paths: array of (pattern, targets)) above the file decides. The deepest configuration goes first. Of its patterns an exact
    one wins, then the longest start; its targets are tried in order, and one outside the repository ends the search. A
    configuration without a fitting pattern decides only if its base URL finds something. Other imports give no row."""
    above = configs.select(F.col("path").alias("config"), directory(F.col("path")).alias("folder"), "base_url", "paths")
    near = imports.select("import_id", "specifier", F.explode(prefixes(directory(F.col("file")))).alias("folder")).join(above, "folder")
    depth = F.when(F.col("folder") == "", F.lit(0)).otherwise(F.size(F.split("folder", "/", -1)))
    near = near.withColumn("depth", -depth)
    fit = F.filter(F.coalesce("paths", F.expr("cast(array() as array<struct<pattern:string,targets:array<string>>>)")), lambda p: fits_pattern(F.col("specifier"), p["pattern"]).isNotNull())
    order = F.transform(fit, lambda p: F.struct(F.when(F.contains(p["pattern"], F.lit("*")), F.lit(1)).otherwise(F.lit(0)).alias("star"), (-F.length(F.substring_index(p["pattern"], "*", 1))).alias("start"), p["pattern"].alias("pattern"), p["targets"].alias("targets")))
    near = near.withColumn("m", F.array_min(order)).withColumn("star", fits_pattern(F.col("specifier"), F.col("m.pattern")))
    alias = near.filter("m is not null").select("import_id", "config", "folder", "depth", "base_url", "star", F.posexplode_outer("m.targets").alias("place", "target"))
    put = F.regexp_replace("target", "^([^*]*)[*]", F.concat(F.lit("$1"), F.replace(F.replace("star", F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))))
    alias = alias.withColumn("kind", F.lit("path-alias")).withColumn("base", joined_path(F.coalesce("base_url", "folder"), put))
    url = near.filter("m is null and base_url is not null").select("import_id", "config", "folder", "depth", "base_url", "star", F.lit(0).alias("place"), F.col("specifier").alias("target"), F.lit("base-url").alias("kind"), joined_path(F.col("base_url"), F.col("specifier")).alias("base"))
    tried = module_files(alias.unionByName(url.filter(inside(F.col("base")))), files, ["import_id", "config", "place"])
    out = (F.col("kind") == "path-alias") & ~inside(F.col("base"))
    said = F.when(out, F.lit("configured-path-alias-outside-repository")).when(F.col("n") > 0, outcome(F.col("n"))).when(F.col("kind") == "path-alias", F.lit("configured-path-alias-target-not-found"))
    last = F.when(said == "configured-path-alias-target-not-found", F.lit(1)).otherwise(F.lit(0))
    best = tried.withColumn("status", said).filter("status is not null").groupBy("import_id").agg(F.min_by(F.struct("config", "kind", "status", "path"), F.struct("depth", "config", last.alias("last"), "place")).alias("x"))
    return best.select("import_id", "x.*")


def shortest_evidence(rows: DataFrame) -> DataFrame:
    """rows (target_id, place, evidence): for each target the row with the least evidence, of equal ones the first."""
    best = rows.groupBy("target_id").agg(F.min_by(F.struct("place", "evidence"), F.struct(F.size("evidence").alias("n"), "place")).alias("x"))
    return best.select("target_id", "x.*")
