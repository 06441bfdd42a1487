"""The scan corpus: files and their lines, from directories or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language by file extension. Files of other extensions have no language, and all rules apply to them.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "java": "java", "rb": "ruby", "php": "php"}
MAX_FILE_SIZE = 100_000


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column | str) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def glob_regex(glob: str) -> str:
    """A path glob (**, *, ?, {a,b}) as an anchored regular expression."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r"\.+^$()[]|{}" else c)
        i += 1
    return f"^{out}$"


def select_paths(files: DataFrame, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    keep = F.lit(False)
    for g in include:
        keep = keep | F.col(path).rlike(glob_regex(g))
    for g in exclude:
        keep = keep & ~F.col(path).rlike(glob_regex(g))
    return files.where(keep)


def read_files(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = ("**/node_modules/**", "**/.git/**", "**/dist/**"), max_size: int | None = MAX_FILE_SIZE) -> DataFrame:
    """A source tree: path (relative to root), content, length, lang. The size limit reaches the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_size is not None:
        raw = raw.where(F.col("length") <= max_size)
    prefix = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^(?:[a-z]+:)?/*" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in prefix.split(":", 1)[-1].lstrip("/")), "")
    named = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), "length")
    return select_paths(named, include, exclude).withColumn("lang", language("path"))


def tables_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, pages and conversations as files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("content"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("conv/"), "conv_id", F.lit("/"), "turn").alias("path"), F.col("text").alias("content"))
    return docs.unionByName(pages).unionByName(turns).withColumn("length", F.octet_length("content").cast("long")).withColumn("lang", language("path"))


def size_cap(files: DataFrame, limit: int = MAX_FILE_SIZE) -> DataFrame:
    return files.where(F.col("length") <= limit)


def for_language(files: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Files that a rule of these languages looks at."""
    if "*" in languages:
        return files
    return files.where(F.col("lang").isNull() | F.col("lang").isin(*languages))


def with_lines(files: DataFrame) -> DataFrame:
    """files with `lines`, an array: windows of lines are slices of it."""
    return files.withColumn("lines", F.split("content", "\n"))


def explode_lines(files: DataFrame) -> DataFrame:
    return files.select("path", "lang", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("path", "lang", (F.col("pos") + 1).alias("line_no"), "line")
