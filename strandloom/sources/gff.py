"""GFF3, GFF2 and GTF. Files are 1-based and inclusive; tables are 0-based and half-open."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..operators.sweep import BLOCK, Step, Take, steps
from ..operators.tables import folder, written
from . import fasta
from .files import numbered

COLUMNS = "seq string, source string, type string, start long, stop long, score double, strand string, phase byte, attributes string"


def read(spark: SparkSession, path, lenient: bool = False, types: list[str] | None = None, seqs: list[str] | None = None, sources: list[str] | None = None, source_types: list[tuple[str, str]] | None = None) -> DataFrame:
    """Feature rows with the map attrs, id, parent and row (the order of files by path, and within them). The filters act before attributes are parsed.

    '.' is null; only lines that begin with # are comments, and quotes have no meaning."""
    df = spark.read.schema(COLUMNS).option("sep", "\t").option("comment", "#").option("nullValue", ".").option("quote", "").csv(path)
    df = numbered(df)
    for col, names in (("type", types), ("seq", seqs), ("source", sources)):
        if names is not None:
            df = df.where(F.col(col).isin(*names))
    if source_types is not None:
        either = [(F.col("source") == s) & (F.col("type") == t) for s, t in source_types]
        df = df.where(reduce(or_, either, F.lit(False)))
    df = df.withColumn("start", F.col("start") - 1).withColumn("attrs", A.parse(F.col("attributes"), lenient))
    return df.withColumn("id", F.try_element_at("attrs", F.lit("ID"))).withColumn("parent", F.try_element_at("attrs", F.lit("Parent")))


def read_gtf(spark: SparkSession, path) -> DataFrame:
    """GFF2 or GTF: `key "value";` attributes; transcript_id (transcriptId, proteinId) is the parent of parts, gene_id of transcripts.
    Values of a repeated key are joined by commas."""
    df = spark.read.schema(COLUMNS).option("sep", "\t").option("comment", "#").option("nullValue", ".").option("quote", "").csv(path)
    df = numbered(df).withColumn("start", F.col("start") - 1)
    keys, plain = F.regexp_extract_all("attributes", F.lit(r'([\w.-]+)\s+(?:"([^"]*)"|([^;"\s]+))'), 1), F.regexp_extract_all("attributes", F.lit(r'([\w.-]+)\s+(?:"([^"]*)"|([^;"\s]+))'), 0)
    values = F.transform(plain, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\w.-]+\s+", ""), '^"|"$', ""))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    attrs = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], F.concat_ws(",", F.try_element_at(m, e["key"]), e["value"]))))
    df = df.withColumn("attrs", F.coalesce(attrs, F.create_map().cast("map<string,string>")))
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    transcript = F.coalesce(get("transcript_id"), get("transcriptId"), get("proteinId"))
    is_t = F.col("type").isin("transcript", "mRNA")
    return df.withColumn("id", F.when(F.col("type") == "gene", get("gene_id")).when(is_t, transcript)).withColumn("parent", F.when(F.col("type") == "gene", F.lit(None)).when(is_t, get("gene_id")).otherwise(transcript))


# Attributes that name a part's transcript in GFF2, in the order in which they are looked for; attributes that name a
# feature of that type or its parent in flat files; the types of parts there.
TRANSCRIPT_KEYS = ("transcript_id", "transcriptId", "proteinId")
FLAT_KEYS = ("Transcript", "CDS")
FLAT_PARTS = ("intron", "exon", "three_prime_UTR", "coding_exon", "five_prime_UTR", "CDS", "stop_codon", "start_codon")


def records(spark: SparkSession, path) -> DataFrame:
    """(row, kind, text, seq, source, type, start, stop, score, strand, phase, id, parents, quals) of every line but comments, of files
    of GFF3, GFF2 or GTF, also mixed, in one scan.

    kind is `directive` (text has what follows ##), `annotation` (no place: about the whole sequence), `child` (has parents),
    `parent` (has an id) or `feature`. quals is a map of arrays. In GFF2 the transcript's id is the parent; in flat files, where the
    attributes Transcript or CDS name a feature, they are the id of a feature of that type and the parent of the parts of one. A
    feature that is its own parent has no id. Lines with fewer than eight fields raise."""
    x = numbered(spark.read.text(path)).withColumn("line", F.trim(F.col("value"))).where((F.col("line") != "") & (F.col("line").startswith("##") | ~F.col("line").startswith("#")))
    plain, f = ~F.col("line").startswith("##"), F.split("line", "\t")
    f = F.when(plain, F.when(F.size(f) >= 8, f).otherwise(F.raise_error(F.concat(F.lit("under eight fields: "), F.col("line"))).cast("array<string>")))
    x = x.withColumn("f", F.transform(f, lambda v: F.when(v != ".", v)))
    field = lambda k: F.get("f", F.lit(k))
    x = x.withColumn("quals", F.when(plain, A.parse_quoted(field(8)))).withColumn("gff3", A.is_gff3(field(8)))
    x = x.select("row", "line", "quals", "gff3", plain.alias("plain"), field(0).alias("seq"), field(1).alias("source"), field(2).alias("type"), (field(3).cast("long") - 1).alias("start"), field(4).cast("long").alias("stop"), field(5).cast("double").alias("score"), F.when(field(6).isin("+", "-"), field(6)).alias("strand"), field(7).cast("byte").alias("phase"))
    get = lambda k: F.try_element_at("quals", F.lit(k))
    named = F.coalesce(*(get(k) for k in TRANSCRIPT_KEYS))
    flat = F.coalesce(*(F.when(get(k).isNotNull(), F.lit(k)) for k in FLAT_KEYS))
    own, from_flat = F.get(get("ID"), 0), F.try_element_at("quals", flat)
    is_flat = (F.col("type") == flat) & own.isNull()
    ident = F.when(~F.col("gff3") & is_flat, F.get(from_flat, 0)).otherwise(own)
    part = ~F.coalesce(F.col("type") == flat, F.lit(False)) & F.col("type").isin(*FLAT_PARTS)
    parents = F.when(F.col("gff3"), get("Parent")).otherwise(F.coalesce(F.when(part, from_flat), named, get("Parent")))
    x = x.withColumns({"id": F.when(F.col("plain"), ident), "parents": F.when(F.col("plain"), parents)})
    x = x.withColumn("id", F.when(F.coalesce(F.array_contains("parents", F.col("id")), F.lit(False)), None).otherwise(F.col("id")))
    placed = F.col("start").isNotNull() & F.col("stop").isNotNull()
    kind = F.when(~F.col("plain"), "directive").when(~placed, "annotation").when(F.col("parents").isNotNull(), "child").when(F.col("id").isNotNull(), "parent").otherwise("feature")
    text = F.when(~F.col("plain"), F.substring("line", 3, 1 << 30))
    return x.select("row", kind.alias("kind"), text.alias("text"), "seq", "source", "type", "start", "stop", "score", "strand", "phase", "id", "parents", "quals")


def header(spark: SparkSession, path) -> DataFrame:
    """(path, line): all lines that begin with #, wherever they stand."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.col("line").startswith("#"))


def directives(spark: SparkSession, path) -> DataFrame:
    """(path, name, values) of ## lines; sequence-region starts become 0-based."""
    x = header(spark, path).where(F.col("line").startswith("##")).withColumn("w", F.split(F.trim(F.substring("line", 3, 1 << 30)), r"\s+"))
    values = F.slice("w", 2, 1 << 20)
    region = F.transform(values, lambda v, i: F.when(i == 1, (F.expr("try_cast(w[2] as bigint)") - 1).cast("string")).otherwise(v))
    return x.select("path", F.element_at("w", 1).alias("name"), F.when(F.element_at("w", 1) == "sequence-region", region).otherwise(values).alias("values"))


def embedded_scan(spark: SparkSession, path) -> DataFrame:
    """Pieces of the records of the ##FASTA sections, as fasta.scan() gives them: feature rows have tabs, comments and directives begin
    with #, so what is left are titles and bases; nothing before the first title counts."""
    x = fasta.lines(spark, path)
    return fasta.scan(x.where(F.col("value").startswith(">") | ~(F.col("value").contains("\t") | F.col("value").startswith("#"))))


def embedded_fasta(spark: SparkSession, path) -> DataFrame:
    """(seq, dna) of the ##FASTA section of GFF3 files."""
    return fasta.whole(embedded_scan(spark, path)).select("seq", "dna")


def lines(df: DataFrame):
    """The nine GFF columns of each row as one line, in system A coordinates; `attributes` is used if there, else id and parent."""
    attributes = F.col("attributes") if "attributes" in df.columns else A.id_parent(F.col("id"), F.col("parent"))
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in df.columns else F.lit(".")
    return F.concat_ws("\t", col("seq"), col("source"), col("type"), F.coalesce((F.col("start") + 1).cast("string"), F.lit(".")), col("stop"), col("score"), col("strand"), col("phase"), F.coalesce(attributes, F.lit(".")))


def write(df: DataFrame, path: str, header_lines: list[str] | None = None, order: list[str] | None = None, fill_missing: bool = True) -> None:
    """One sorted text file: header, then features in file order (row) or by `order`. A GFF file is one file by definition: one task
    sorts and writes it, on disk where it must. Nulls become '.'; without fill_missing a null or missing column of the nine raises."""
    if not fill_missing:
        if gone := [c.split()[0] for c in COLUMNS.split(", ") if c.split()[0] not in df.columns]:
            raise ValueError(f"missing columns: {gone}")
        full = reduce(and_, (F.col(c.split()[0]).isNotNull() for c in COLUMNS.split(", ")))
        df = df.withColumn("seq", F.when(full, F.col("seq")).otherwise(F.raise_error(F.lit("a null in a required column"))))
    spark = df.sparkSession
    head = spark.createDataFrame([(-1, i, x) for i, x in enumerate(header_lines or ["##gff-version 3"])], "a int, b long, value string")
    keyed = df.select(F.lit(0).alias("a"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order or ["row"])], lines(df).alias("value"))
    keys = [c for c in keyed.columns if c[0] == "k"]
    body = keyed.orderBy(*keys).select("value")
    head.orderBy("b").select("value").coalesce(1).unionByName(body).coalesce(1).write.mode("overwrite").text(path)


def normalise(df: DataFrame, tag: str = "Ensembl_canonical") -> DataFrame:
    """Rows of read() from files with several transcripts of a gene: each known gene with a transcript, one transcript of it as mRNA
    with longest=1, and that one's exons, CDS and UTRs, with ids type:parent:start:stop:strand (1-based).

    A transcript with the tag goes before others, then the longest one, then the first of the file. A gene or chosen transcript with
    several rows raises. Of several parents the first chosen one counts."""
    first = F.trim(F.element_at(F.filter(F.split("parent", ","), lambda p: F.trim(p) != ""), 1))
    is_t = F.col("type").isin("mRNA", "transcript")
    genes = df.where("type = 'gene' and id <> ''").groupBy(F.col("id").alias("_gene")).agg(F.count(F.lit(1)).alias("_n"))
    tagged = F.array_contains(F.transform(F.split(F.coalesce(F.try_element_at("attrs", F.lit("tag")), F.lit("")), ","), lambda t: F.trim(t)), tag)
    t = df.where(is_t & (F.col("id") != "")).select(F.col("id").alias("_id"), first.alias("_gene"), F.struct(tagged.alias("c"), (F.col("stop") - F.col("start")).alias("n"), (-F.col("row")).alias("r")).alias("_rank"))
    best = t.join(genes, "_gene").groupBy("_gene").agg(F.max(F.struct("_rank", "_id"))["_id"].alias("_id"), F.max("_n").alias("_n"))
    times = t.groupBy("_gene", "_id").agg(F.count(F.lit(1)).alias("_m"))
    best = best.join(times, ["_gene", "_id"]).select("_gene", F.when((F.col("_n") == 1) & (F.col("_m") == 1), F.col("_id")).otherwise(F.raise_error(F.concat(F.lit("several rows of "), "_gene"))).alias("_id"))
    cols = [c for c in df.columns if c not in ("type", "id", "parent", "attrs", "attributes")]
    out = lambda x, kind, ident, parent, attrs: x.select(*cols, kind.alias("type"), ident.alias("id"), parent.alias("parent"), attrs.alias("attrs"))
    put = lambda *kv: F.map_concat(F.map_filter("attrs", lambda k, _: ~k.isin(*[a for a, _ in kv])), F.create_map(*(v for a, b in kv for v in (F.lit(a), b))))
    g = out(df.where("type = 'gene'").join(best, F.col("id") == F.col("_gene")), F.col("type"), F.col("id"), F.col("parent"), F.col("attrs"))
    m = df.where(is_t).withColumn("_gene", first).withColumnRenamed("id", "_id").join(best, ["_gene", "_id"])
    m = out(m, F.lit("mRNA"), F.col("_id"), F.col("parent"), put(("longest", F.lit("1"))))
    c = df.where(F.col("type").isin("exon", "CDS", "five_prime_UTR", "three_prime_UTR")).select("*", F.posexplode(F.split("parent", ",")).alias("_k", "_p")).withColumn("_id", F.trim("_p"))
    c = c.join(best.select("_id"), "_id").withColumn("_o", F.row_number().over(Window.partitionBy("row").orderBy("_k"))).where("_o = 1")
    name = F.concat_ws(":", "type", "_id", F.col("start") + 1, "stop", "strand")
    c = out(c, F.col("type"), name, F.col("_id"), put(("Parent", F.col("_id")), ("ID", name)))
    return g.unionByName(m).unionByName(c).withColumn("attributes", A.render(F.col("attrs"))).select(*df.columns)


def load(spark: SparkSession, path, drop: list[str] | None = None) -> DataFrame:
    """read() with normalised attribute names and without the attributes in drop; `attributes` is written anew. Names that clash raise."""
    df = read(spark, path)
    names = F.transform_keys("attrs", lambda k, _: F.lower(F.regexp_replace(F.trim(k), r"\s+", "_")))
    gone = [A.column_name(d) for d in drop or []]
    attrs = F.map_filter("attrs", lambda k, _: ~F.lower(F.regexp_replace(F.trim(k), r"\s+", "_")).isin(*gone)) if gone else F.col("attrs")
    return df.withColumn("attrs", attrs).withColumn("attributes", A.render(F.col("attrs"))).withColumn("attrs", names)


def promote(df: DataFrame, keys: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Attribute columns. Without keys one pass discovers them (attribute names are a small set; at most 10,000 are taken)."""
    if keys is None:
        keys = sorted(r[0] for r in df.select(F.explode(F.map_keys("attrs"))).distinct().limit(10_001).collect())
        if len(keys) > 10_000:
            raise ValueError("over 10,000 attribute names")
    names = [prefix + A.column_name(k) for k in keys]
    if clash := {n for n in names if names.count(n) > 1} | {n for n in names if not prefix and n in ("seq", "source", "type", "start", "stop", "score", "strand", "phase", "attributes", "row")}:
        raise ValueError(f"attribute names clash: {sorted(clash)}")
    return df.select(*[c for c in df.columns if c not in names], *(F.try_element_at("attrs", F.lit(k)).alias(n) for k, n in zip(keys, names, strict=True)))


def merge_files(tables: dict[str, DataFrame], prefix: bool = True) -> DataFrame:
    """Union of feature tables by name; with prefix, ids and parents begin with the table's name."""
    out = None
    for k, (name, df) in enumerate(tables.items()):
        x = df.withColumn("_file", F.lit(k))
        if prefix:
            x = x.withColumn("attributes", A.prefix_ids(F.col("attributes"), f"{name}_")).withColumn("id", F.concat(F.lit(f"{name}_"), "id")).withColumn("parent", F.concat(F.lit(f"{name}_"), F.replace(F.col("parent"), F.lit(","), F.lit(f",{name}_"))))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def merge_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, split, id, value): the lines of files in the order given, which sorting by the first three keeps. Missing files are left out;
    lines that begin with # come from the first file there is; blank lines go; lines with under nine fields stay as they are, in others
    the ID and all parents get the sequence's name and _ before them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    if not there:
        raise FileNotFoundError(f"none of {paths}")
    out = None
    for k, p in enumerate(there):
        x = spark.read.text(p).select(F.lit(k).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
        x = x.where(F.trim("value") != "" if k == 0 else (F.trim("value") != "") & ~F.col("value").startswith("#"))
        out = x if out is None else out.unionByName(x)
    f = F.split("value", "\t")
    seq = F.concat(F.regexp_replace(F.get(f, 0), r"([\\$])", r"\\$1"), F.lit("_"))  # a pattern's own signs are letters here
    named = F.regexp_replace(F.get(f, 8), F.lit("(^|;)ID="), F.concat(F.lit("$1ID="), seq))
    parents = F.transform(F.split(F.regexp_extract(named, "(?:^|;)Parent=([^;]*)", 1), ","), lambda v: F.concat(F.get(f, 0), F.lit("_"), v))
    listed = F.regexp_replace(F.array_join(parents, ","), r"([\\$])", r"\\$1")
    named = F.when(named.rlike("(^|;)Parent=[^;]"), F.regexp_replace(named, F.lit("(^|;)Parent=[^;]*"), F.concat(F.lit("$1Parent="), listed))).otherwise(named)
    changed = F.concat_ws("\t", F.slice(f, 1, 8), F.array(named), F.slice(f, 10, 1 << 20))
    return out.withColumn("value", F.when(F.col("value").startswith("#") | (F.size(f) < 9), F.col("value")).otherwise(changed))


def write_merged(spark: SparkSession, paths: list[str], out: str) -> None:
    """merge_lines() as text in sorted parts: one after the other they are the merged file."""
    merge_lines(spark, paths).orderBy("file", "split", "id").select("value").write.mode("overwrite").text(out)


def profile(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by (seq, source, type), and (parent_type, child_type, n)."""
    counts = df.groupBy("seq", "source", "type").count()
    p = df.where("id is not null").select(F.col("id").alias("parent"), F.col("type").alias("parent_type"))
    return counts, df.where("parent is not null").join(p, "parent").groupBy("parent_type", F.col("type").alias("child_type")).count()


def match_record_id(names: DataFrame, records: DataFrame) -> DataFrame:
    """(name, record): names found as a record id or as one of its pipe-delimited parts."""
    parts = records.select(F.col("id").alias("record"), F.explode(F.array_union(F.array("id"), F.split("id", r"\|"))).alias("name")).where("name <> ''")
    return names.join(parts, "name").groupBy("name").agg(F.min("record").alias("record"))


def closed_regions(df: DataFrame, target: int = 100_000, width: int = BLOCK) -> DataFrame:
    """Rows of read() with `region`, the row at which the smallest stretch of the file begins that no tree leaves, and `part`, which puts
    regions together that begin within the same `target` rows.

    A name (an id or one of the parents) reaches from its first row to its last one, wherever children stand; a region ends where no
    name reaches beyond. So a part can be parsed, written and forgotten on its own, and is as long as `target` rows and the
    trees still open then. Reaches come from one aggregation; a sweep in blocks of rows finds the ends. The rows are written first, as they are read for both."""
    df = written(df, "rows")
    parents = F.filter(F.split("parent", ","), lambda p: F.trim(p) != "")
    names = df.select("row", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("id"), F.coalesce(F.transform(parents, lambda p: F.trim(p)), F.array().cast("array<string>")))))).alias("name"))
    reach = names.groupBy("name").agg(F.min("row").alias("row"), F.max("row").alias("_to")).where("row < _to")
    whole = F.struct(*df.columns)
    none = F.lit(None).cast(df.select(whole.alias("r")).schema["r"].dataType)
    x = df.select("row", F.lit(None).cast("long").alias("_to"), whole.alias("_row")).unionByName(reach.select("row", "_to", none.alias("_row")))
    # a name opens after the row that it begins at
    order = [F.col("row"), F.col("_row").isNull()]
    begins = F.when(F.col("_row").isNotNull() & (F.col("_open").isNull() | (F.col("_open") < F.col("row"))), F.col("row"))
    x = steps(x, [], "row", [Step(order, {"_open": Take("max", F.col("_to"))}), Step(order, {"region": Take("near", F.col("_begins"), here=True)}, {"_begins": begins})], width)
    return x.where("_row is not null").select(*(F.col(f"_row.{c}").alias(c) for c in df.columns), "region", F.floor(F.col("region") / F.lit(target)).alias("part"))


def parse_in_parts(spark: SparkSession, path, target: int = 100_000, **scan) -> Iterator[DataFrame]:
    """The rows of read() part after part, in file order, each with whole trees only. They are written once, by part; then one part at a
    time is read."""
    table = folder(spark, "parts")
    closed_regions(read(spark, path, **scan), target).repartition("part").write.partitionBy("part").parquet(table)
    whole = spark.read.parquet(table)
    for (part,) in sorted(whole.select("part").distinct().toLocalIterator()):
        yield whole.where(F.col("part") == part).drop("part", "region")
