"""Source scan of a repository: files, ignore rules, modules, zones, hashes and line slices, as DataFrame expressions."""

from __future__ import annotations

from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.scalar import posix, prefixed_sha256
from graphmill.model import blank

# Directory names, markers and patterns of the source layout rules.
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".mypy_cache", ".pytest_cache", ".graphmill", ".ruff_cache", ".svn", ".tox", ".venv", "__pycache__",
    "build", "dist", "node_modules", "out", "target", "venv",
)
BUILD_OUTPUTS = ("build", "out", "target")
GENERATED_MARKERS = ("generated", "generated-sources")
SOURCE_ROOTS = ("src/main/java", "src/test/java", "src/generated/java", "generated/src/main/java", "generated-sources")
MAVEN_MARKER = "pom.xml"
GRADLE_MARKERS = ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
ZONE_PARTS = (
    ("generated", ("generated", "generated-sources", "build", "out", "target")),
    ("vendor", ("vendor", "third_party", "third-party", "external")),
    ("tooling", ("tool", "tools", "tooling", "script", "scripts", "buildsrc", "build-logic")),
    ("test", ("test", "tests", "it", "integrationtest", "integration-test")),
)


def texts(values) -> Column:
    return F.array(*map(F.lit, values))


def parts(path: Column) -> Column:
    return F.split(F.lower(posix(path)), "/")


def is_ignored(path: Column) -> Column:
    """Whether a part of the path names an ignored directory. Build outputs alone don't count below a generated-source marker."""
    named = F.array_intersect(parts(path), texts(IGNORED_DIRECTORIES))
    outputs_only = F.size(F.array_except(named, texts(BUILD_OUTPUTS))) == 0
    return (F.size(named) > 0) & ~(outputs_only & F.arrays_overlap(parts(path), texts(GENERATED_MARKERS)))


def file_zone(path: Column) -> Column:
    zone = F.lit("prod")
    for name, wanted in reversed(ZONE_PARTS):
        zone = F.when(F.arrays_overlap(parts(path), texts(wanted)), name).otherwise(zone)
    return zone


def module_zone(zone: Column) -> Column:
    return F.when(zone.isin("vendor", "tooling"), zone).otherwise("prod")


def module_name(root: Column) -> Column:
    return F.when(root == ".", "root").otherwise(F.replace(root, F.lit("/"), F.lit(":")))


def source_root(path: Column) -> Column:
    """The first of the known source roots at the head of a module-relative path, in its own spelling; else '.'."""
    root = F.lit(".")
    for pattern in reversed(SOURCE_ROOTS):
        n = pattern.count("/") + 1
        root = F.when(F.array_join(F.slice(parts(path), 1, n), "/") == pattern, F.array_join(F.slice(F.split(posix(path), "/"), 1, n), "/")).otherwise(root)
    return root


def prefixes(path: Column) -> Column:
    """The directories above a file, the repository's root ('.') first."""
    up = F.split(posix(path), "/")
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.size(up) - 1, F.lit(1))), lambda n: F.array_join(F.slice(up, F.lit(1), n), "/"))
    return F.when(F.size(up) > 1, F.concat(F.array(F.lit(".")), below)).otherwise(F.array(F.lit(".")))


def with_modules(files: DataFrame, markers: DataFrame) -> DataFrame:
    """files (path, ...) with module_root, module_ecosystem, module_name, file_zone, module_zone, source_root.

    markers: directory, file. The longest marked ancestor wins, '.' where there is none: ancestors are exploded and met by
    one equi-join, then a grouped maximum.
    """
    marked = markers.groupBy("directory").agg(F.max(F.col("file") == MAVEN_MARKER).alias("maven"))
    above = files.select("path", F.posexplode(prefixes(F.col("path"))).alias("depth", "directory"))
    nearest = above.join(marked, "directory").groupBy("path").agg(F.max(F.struct("depth", "directory", "maven")).alias("m"))
    placed = files.join(nearest, "path", "left").withColumn("module_root", F.coalesce("m.directory", F.lit(".")))
    own = F.when(F.col("module_root") == ".", F.col("path")).otherwise(F.expr("substring(path, length(module_root) + 2)"))
    return placed.select(
        *files.columns, "module_root", F.when(F.coalesce("m.maven", F.lit(True)), "maven").otherwise("gradle").alias("module_ecosystem"), module_name(F.col("module_root")).alias("module_name"),
        file_zone(own).alias("file_zone"), module_zone(file_zone(own)).alias("module_zone"), source_root(own).alias("source_root"),
    )


def scan(spark: SparkSession, repository: str, suffix: str = ".java") -> DataFrame:
    """(path, content, content_hash, module columns) of a repository's source files, ignored ones left out, by path.

    Listing and reading run in Spark, from any store it reads; build markers come from a second listing without contents.
    """
    base = repository.rstrip("/")
    relative = F.expr(f"substring(file, {len(base) + 2})")
    plain = F.regexp_replace("path", "^file:/+", "/")
    named = F.when(F.lit("://" in base), F.col("path")).otherwise(plain)
    read = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    files = read(f"*{suffix}").select(named.alias("file"), "content").select(relative.alias("path"), "content").filter(~is_ignored(F.col("path")))
    marks = read("{" + ",".join((MAVEN_MARKER, *GRADLE_MARKERS)) + "}").select(named.alias("file")).select(relative.alias("path"))
    markers = marks.select(F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(".")).alias("directory"), F.substring_index("path", "/", -1).alias("file"))
    return with_modules(files.withColumn("content_hash", prefixed_sha256(F.col("content"))), markers).orderBy("path")


def target_faults(files: DataFrame) -> DataFrame:
    """(path, fault) for each rule that a file to be parsed breaks: no blank module column, and zones that are known."""
    zones = (*(name for name, _ in ZONE_PARTS), "prod")
    rules = [(f"blank {c}", blank(F.col(c))) for c in ("module_name", "module_root", "module_ecosystem", "module_zone", "file_zone")]
    rules += [(f"unknown {c}", ~blank(F.col(c)) & ~F.col(c).isin(*zones)) for c in ("module_zone", "file_zone")]
    return files.select("path", F.explode(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))).alias("fault"))


def line_slice(texts_: DataFrame, text: str, start: Column, end: Column, max_lines: int = 120) -> DataFrame:
    """Adds slice, slice_start, slice_end, truncated and total_lines: lines start to end of the text, max_lines at most.

    A range that starts below 1 or past the text, or ends before its start, has a null slice.
    """
    lines = F.split(F.regexp_replace(F.col(text), "\r\n|\r", "\n"), "\n", -1)
    total = F.size(lines) - F.when(F.endswith(F.col(text), F.lit("\n")), 1).otherwise(0)
    valid = (start >= 1) & (end >= start) & (start <= total)
    last = F.least(end, total, start + (max_lines - 1))
    piece = F.array_join(F.slice(lines, start, F.greatest(last - start + 1, F.lit(0))), "\n")
    return texts_.withColumns(
        {
            "slice": F.when(valid, piece), "slice_start": F.when(valid, start), "slice_end": F.when(valid, last),
            "truncated": F.when(valid, last < F.least(end, total)), "total_lines": total,
        }
    )


def read_slice(repository: str, relative_path: str, start_line: int, end_line: int, max_lines: int = 120) -> dict:
    """One file's slice on the driver, its path checked to stay inside the repository."""
    if start_line < 1 or end_line < start_line or max_lines < 1:
        raise ValueError("bad line range")
    relative_path = normalize_relative_path(repository, relative_path)
    path = Path(repository, relative_path)
    if not path.is_file():
        raise FileNotFoundError(relative_path)
    try:
        lines = path.read_bytes().decode("utf-8").splitlines()
    except UnicodeDecodeError as error:
        raise ValueError(f"{relative_path} is not UTF-8") from error
    last = min(end_line, start_line + max_lines - 1, len(lines))
    return {"relative_path": relative_path, "start_line": start_line, "end_line": last, "text": "\n".join(lines[start_line - 1 : last]), "truncated": last < min(end_line, len(lines)), "total_lines": len(lines)}


def normalize_relative_path(repository: str, relative_path: str) -> str:
    """The path inside the repository, with forward slashes; paths that lead out of it are refused."""
    root = Path(repository).resolve()
    target = (root / PurePosixPath(relative_path.replace("\\", "/"))).resolve()
    if not target.is_relative_to(root) or target == root:
        raise ValueError(f"path leaves the repository: {relative_path}")
    return target.relative_to(root).as_posix()
