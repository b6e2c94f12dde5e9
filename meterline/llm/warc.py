"""WARC archives: writing captures, reading them back, assembling transactions.

*Writing.*  A capture is a request, a response (or a revisit, when an earlier
capture has an equal payload) and a metadata record; request and metadata name
the response in ``WARC-Concurrent-To``.  Records are rows of bytes, written by
Spark's text writer with CRLF CRLF between them, so the files are WARC/1.1.
A payload that contains a record mark is sent in HTTP chunks that cut the
mark, so a mark in an archive always begins a record.

*Reading.*  The text reader splits files at the record mark of WARC/1.0 and 1.1:
archives need not fit in memory and plain ones are read by many tasks.  Blocks
are bytes.  A block shorter than its Content-Length, or a piece without a record
id, is reported (``complete`` is false), never dropped.

*Assembly.*  Records are linked by every ``WARC-Concurrent-To`` line of either
side.  A record goes to the answers (responses, revisits, resources) it names or
that name it; the records left go, through chains of any length, to the first
answer of their connected component; a record without one is a row of its own.

Defined cases: a null payload is empty, binary payloads are kept byte for byte;
a null or empty URL is read back as null; line breaks in URLs are
percent-encoded; rows that repeat id and payload make equal records, which
count as one request and one metadata record; an empty table gives an archive
folder without records; extra columns are ignored; payloads may be of any
length that one row holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterline.llm.common import stored
from meterline.llm.components import components
from meterline.session import checkpoint_dir

CRLF = "\r\n"
MARK = "WARC/1.1\r\n"
#: Starts a record; the digit of the version follows.
START = "\nWARC/1."
ANSWERS, PARTS = ("response", "revisit", "resource"), ("request", "metadata")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 8 groups of 20 bits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    """A record id that is the same whenever the row is computed."""
    h = F.md5(F.concat_ws("\0", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, nothing when the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record(fields: list[Column], block: Column) -> Column:
    length = _field("Content-Length", F.octet_length(block).cast("string"))
    return F.concat(F.concat(F.lit(MARK), *fields, length, F.lit(CRLF)).cast("binary"), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
             min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, digest, bytes, first): ``first`` is the smallest id with
    an equal payload of at least ``min_bytes``, or the row's own.  Digests are
    counted before the join, which AQE splits where one payload is very common."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    same = stored(rows.select("id", "digest", "bytes").where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
                  .agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-payloads")
    return rows.join(same, ["digest", "bytes"], "left").withColumn("first", F.coalesce("low", "id")).drop("low")


def records(caps: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The text of each WARC record, three per capture."""
    revisit = ~F.col("first").eqNullSafe(F.col("id"))
    rid = lambda kind, i: _uuid(F.lit(kind), i.cast("string"), F.col("digest"), F.col("bytes").cast("string"))
    response, first = rid("response", F.col("id")), rid("response", F.col("first"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/]*://([^/?#]*)", 1)
    common = lambda kind, i: [_field("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind),
                              _field("WARC-Record-ID", i), _field("WARC-Date", F.lit(date)),
                              _field("WARC-Target-URI", F.concat(F.lit("<"), url, F.lit(">")))]
    concurrent = _field("WARC-Concurrent-To", response)
    ask = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host,
                   F.lit(CRLF + CRLF))
    # chunked where the payload holds a record mark: every mark is cut after "WARC/"
    text = F.decode("payload", "ISO-8859-1")  # one character a byte
    marked = F.contains(F.col("payload"), F.lit(b"WARC/1."))
    pieces = F.split(text, r"(?<=WARC/)(?=1\.)")
    chunks = F.encode(F.concat(F.array_join(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.concat(
        F.lower(F.hex(F.length(p))), F.lit(CRLF), p, F.lit(CRLF))), ""), F.lit("0" + CRLF + CRLF)), "ISO-8859-1")
    body = F.when(marked, F.concat(F.lit(f"Transfer-Encoding: chunked{CRLF}{CRLF}").cast("binary"), chunks)).otherwise(
        F.concat(F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF)).cast("binary"), F.col("payload")))
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
    block = F.when(revisit, F.lit((head + CRLF).encode())).otherwise(F.concat(F.lit(head.encode()), body))
    digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    note = F.concat(F.lit("capture: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF))
    kind = F.when(revisit, "revisit").otherwise("response")
    three = F.array(
        _record([*common(kind, response), _field("Content-Type", F.lit("application/http; msgtype=response")), digest,
                 _field("WARC-Profile", profile), _field("WARC-Refers-To", F.when(revisit, first))], block),
        _record([*common("request", rid("request", F.col("id"))),
                 _field("Content-Type", F.lit("application/http; msgtype=request")), concurrent], ask.cast("binary")),
        _record([*common("metadata", rid("metadata", F.col("id"))),
                 _field("Content-Type", F.lit("application/warc-fields")), concurrent], note.cast("binary")))
    return caps.select(F.explode(three).alias("value")).select(F.col("value").cast("string"))


def write(recs: DataFrame, path: str, compression: str = "gzip") -> None:
    recs.write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def scratch_archive(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder, deleted at the end."""
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, date, uri, concurrent_to, refers_to, digest, fields, block,
    complete) of every record, ids and URIs without angle brackets,
    ``concurrent_to`` an array of all ids named, ``fields`` the whole header and
    ``block`` its bytes; ``complete`` is false where the block's length is not
    the Content-Length."""
    piece = spark.read.option("lineSep", START).text(path).where(r"value rlike '[^\r\n]'")
    cut = F.expr(r"instr(value, '\r\n\r\n')")
    head = F.when(F.col("at") > 0, F.expr("left(value, at - 1)")).otherwise(F.col("value"))
    parsed = piece.withColumn("at", cut).select(
        F.regexp_replace(head, r"^(?:WARC/1\.)?[0-9]+\r\n", "").alias("fields"),
        F.when(F.col("at") > 0, F.expr("substring(cast(value as binary), octet_length(left(value, at + 3)) + 1)"))
        .otherwise(F.lit(b"")).alias("rest"))

    def get(name: str) -> Column:
        return F.nullif(F.regexp_extract("fields", rf"(?i)(?:^|\r\n){name}:[ \t]*<?([^\r\n]*?)>?[ \t]*(?:\r\n|$)", 1), F.lit(""))

    length = F.coalesce(get("Content-Length").try_cast("long"), F.lit(-1).cast("long"))
    # two line breaks close a record; the mark has taken the last character, but at a file's end
    extra = F.octet_length("rest") - length
    closing = F.substring("rest", length.cast("int") + 1, F.lit(4))
    closed = ((extra == 4) & (closing == F.lit(b"\r\n\r\n"))) | ((extra == 3) & (closing == F.lit(b"\r\n\r")))
    block = F.when(closed, F.substring("rest", F.lit(1), length.cast("int"))).otherwise(F.col("rest"))
    named = F.array_distinct(F.regexp_extract_all("fields", F.lit(
        r"(?i)(?:(?<=^)|(?<=\n))WARC-Concurrent-To:[ \t]*<?([^\r\n>]+)>?"), F.lit(1)))
    out = parsed.select(get("WARC-Type").alias("type"), get("WARC-Record-ID").alias("id"), get("WARC-Date").alias("date"),
                        get("WARC-Target-URI").alias("uri"), named.alias("concurrent_to"),
                        get("WARC-Refers-To").alias("refers_to"), get("WARC-Payload-Digest").alias("digest"),
                        "fields", length.alias("length"), block.alias("block"))
    return out.withColumn("complete", (F.octet_length("block") == F.col("length")) & F.col("id").isNotNull()).drop("length")


def payload_of(block: Column) -> Column:
    """The entity body (bytes) of an HTTP response block, chunks joined by their sizes."""
    text = block.cast("string")
    at = F.instr(text, CRLF + CRLF)
    head = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise("")
    body = F.when(at > 0, F.substring(block, F.octet_length(F.substr(text, F.lit(1), at + 3)) + 1, F.octet_length(block))) \
        .otherwise(F.lit(b""))
    rounds = F.regexp_count(body.cast("string"), F.lit(r"\r\n[0-9A-Fa-f]+\r\n")) + 1

    def step(acc: Column, _: Column) -> Column:
        size = F.substring_index(acc["rest"].cast("string"), CRLF, 1)
        n = F.conv(size, 16, 10).cast("int")
        start = F.octet_length(size) + 3
        piece = F.substring(acc["rest"], start, n)
        more = (size != "") & (n > 0)
        return F.struct(F.when(more, F.substring(acc["rest"], start + n + 2, F.octet_length(acc["rest"]))).otherwise(F.lit(b"")).alias("rest"),
                        F.when(more, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    joined = F.aggregate(F.sequence(F.lit(1), rounds), F.struct(body.alias("rest"), F.lit(b"").alias("out")), step)["out"]
    return F.when(F.contains(F.lower(head), F.lit("transfer-encoding: chunked")), joined).otherwise(body)


def _ids(recs: DataFrame) -> Column:
    """The named ids as an array, whatever form the column has."""
    one = recs.schema["concurrent_to"].dataType.simpleString() == "string"
    return F.array_compact(F.array("concurrent_to")) if one else F.col("concurrent_to")


def _named(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, answer) pairs of request and metadata records that name an answer
    or are named by one, and all (a, b) links between records."""
    link = recs.select(F.col("id").alias("a"), "type", F.explode(_ids(recs)).alias("b")).where("a is not null and a != b")
    answers = recs.where(F.col("type").isin(*ANSWERS)).select(F.col("id").alias("b")).where("b is not null").distinct()
    parts = recs.where(F.col("type").isin(*PARTS)).select(F.col("id").alias("b")).where("b is not null").distinct()
    to = link.where(F.col("type").isin(*PARTS)).join(answers, "b", "left_semi").select(F.col("a").alias("part"), F.col("b").alias("answer"))
    back = link.where(F.col("type").isin(*ANSWERS)).join(parts, "b", "left_semi").select(F.col("b").alias("part"), F.col("a").alias("answer"))
    return stored(to.unionByName(back).distinct(), "warc-direct"), link.select("a", "b")


def resolved(recs: DataFrame) -> DataFrame:
    """(part, answer): the answers of every request and metadata record that has
    any.  Chains are followed for the records that no direct link resolves."""
    direct, link = _named(recs)
    left = stored(recs.where(F.col("type").isin(*PARTS) & F.col("id").isNotNull()).select(F.col("id").alias("part")).distinct()
                  .join(direct, "part", "left_anti"), "warc-unresolved")
    ends = link.select("a", "b").unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chains = ends.join(left, ends["a"] == left["part"], "left_semi")
    roots = components(chains)
    known = direct.select(F.col("part").alias("node"), "answer").unionByName(
        recs.where(F.col("type").isin(*ANSWERS)).select(F.col("id").alias("node"), F.col("id").alias("answer")))
    first = roots.join(known, "node").groupBy("root").agg(F.min("answer").alias("answer"))
    far = left.join(roots, left["part"] == roots["node"]).join(first, "root").select("part", "answer")
    return direct.unionByName(far)


def assemble(recs: DataFrame, carry: tuple[str, ...] = ("block", "complete")) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``uri``, ``response`` (type, id,
    refers_to, digest and the columns ``carry`` of ``recs``, its block by
    default), lists ``requests`` and ``metadata`` of (oid, block, complete).

    Records of no capture (orphans, other types such as warcinfo, records
    without id) follow as rows of their own: ``capture_id`` null, the record in
    ``response``, or in its list if it is a request or metadata record.  The lists
    are as long as one transaction.  Blocks of responses are not grouped."""
    part = F.struct(F.col("id").alias("oid"), "block", "complete").alias("part")
    others = recs.where(F.col("type").isin(*PARTS)).select("id", "uri", "type", part).distinct()
    to = stored(resolved(recs), "warc-resolved")
    placed = others.join(to, others["id"] == to["part"]).select("answer", "type", others["part"])
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("part"))))
    lists = placed.groupBy("answer").agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    whole = F.struct("type", "id", "refers_to", "digest", *carry).alias("response")
    answer = F.col("type").isin(*ANSWERS) & F.col("id").isNotNull()
    none = F.array().cast(lists.schema["requests"].dataType)
    caps = recs.where(answer).select(F.col("id").alias("capture_id"), "uri", whole).join(lists, F.col("capture_id") == F.col("answer"), "left") \
        .select("capture_id", "uri", "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))
    lost = others.join(to, others["id"] == to["part"], "left_anti")
    here = lambda kind: F.when(F.col("type") == kind, F.array("part")).otherwise(none)
    null = F.lit(None).cast("string")
    orphans = lost.select(null.alias("capture_id"), "uri", F.lit(None).cast(caps.schema["response"].dataType).alias("response"),
                          here("request").alias("requests"), here("metadata").alias("metadata"))
    rest = recs.where(~F.coalesce(answer | F.col("type").isin(*PARTS), F.lit(False))).select(
        null.alias("capture_id"), "uri", whole, none.alias("requests"), none.alias("metadata"))
    return caps.unionByName(orphans).unionByName(rest)
