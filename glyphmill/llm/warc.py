"""WARC archives: write one record for each page, read the archives back, and merge their locally sorted capture indexes
into globally ordered capture histories with a k-way loser tree."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_schema, batch_of, new_path, rows_of, running_sums, written

END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes of an archive file, about; a reader holds one file at a time.
FILE_BYTES = 16 << 20
#: Index rows of a range, about; ranges give tasks of even size, a merge's memory doesn't follow them.
RANGE_ROWS = 250_000
#: Runs that are merged at once, and rows of a block: a merge holds a block or two of each run.
FAN_IN, BLOCK_ROWS = 64, 256
FIRST_CAPTURE = 1704067200  # 2024-01-01; a page's capture date is so many seconds, plus its id (mod 10^9), after the epoch


def base32(sha1_hex: Column) -> Column:
    """RFC 4648 base32 of 160 bits given as 40 hex digits: eight parts of 20 bits, four characters each."""
    part = lambda i: F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
    chars = [F.substring(F.lit(ALPHABET), F.shiftright(part(i), 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for j in range(4)]
    return F.concat(*chars)


def url_key(url: Column) -> Column:
    """The host's labels in reverse order, then the rest: captures of a site sort together."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[^:/?#]*://", "")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), "\\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.lit(1 << 30)))


def records(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, min_revisit_bytes: int) -> DataFrame:
    """One WARC record for each page, as text without the two line breaks at its end.

    Of payloads that are equal and have at least min_revisit_bytes, that of the largest id is a response, the others revisit it.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    # who revisits whom is found on hashes; payloads are dealt by id and hash, so that equal ones don't meet in a task
    row = F.concat_ws(":", "sha1", F.col("page_id").cast("string")).alias("row")
    hashes = written(rows.select(row, "page_id", "sha1", F.octet_length("payload").cast("long").alias("bytes")), "warc-hashes")
    of_equal = hashes.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last is not null")
    told = hashes.join(of_equal, "sha1").where("page_id is null OR page_id < last").select("row", "last").distinct()
    files = max(1, -(-(hashes.agg(F.sum("bytes")).first()[0] or 0) // FILE_BYTES))
    rows = rows.withColumn("row", row).repartition(files, "row").join(told, "row", "left")
    revisit = F.col("last").isNotNull()
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.translate("url", "\r\n", "")
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), target,
            F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("last").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
            F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")), F.lit("\r\nX-Url-Key: "), url_key(target),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
        ).alias("value")
    )


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Compressed archives through Spark's own writer, so that they can lie in any store and survive lost tasks."""
    out = records(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit_bytes=min_revisit_bytes)
    out.write.options(lineSep=END, compression="gzip").text(path)


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(where it starts, what it holds) of each gzip member of a file: one for a whole file, or one for each record."""
    at = 0
    while at < len(content):
        start, out, one = at, [], zlib.decompressobj(wbits=47)
        while not one.eof and at < len(content):
            chunk = content[at : at + 65536]
            out.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        if not one.eof:
            raise ValueError("the last gzip member is cut off")
        yield start, b"".join(out)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and place of each record, by the lengths that the headers tell."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = stop + 4
        end = start + int(headers["Content-Length"])
        yield headers, content[start:end], at
        at = end + len(END)


def _id(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_INDEX = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, member long, offset long, run string"
_INDEX_SCHEMA = arrow_schema(_INDEX)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back into index rows, one locally sorted run for each file. Digests are made from the payloads as read;
    that of a revisit, which has none, is the header's, and its length is left open. member and offset tell where a record is: the start of its
    gzip member in the file, and its place in that."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in rows_of(batch):
                out = []
                for member, h, block, at in ((m, *r) for m, part in members(content) for r in parsed(part)):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    mark = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = h["WARC-Type"] == "revisit"
                    if not revisit and digest(payload) != mark:
                        raise ValueError(f"{name}: the payload of {h['WARC-Record-ID']} doesn't match its digest")
                    refers = _id(h["WARC-Refers-To"]) if revisit else None
                    out.append((h["X-Url-Key"], h["WARC-Date"], _id(h["WARC-Record-ID"]), None if revisit else len(payload), mark, h["WARC-Type"], refers, member, at, name.rpartition("/")[2]))
                yield batch_of(sorted(out, key=_order), _INDEX_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(indexed, _INDEX)


def _order(row: Sequence) -> tuple:
    """URL key by its bytes, then capture date, then id with null first."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """The smallest of k keys, the first of equal ones. Each inner node keeps the loser of its match, so that after the winner's next key one match for each level is played.
    A key of None loses to all others."""

    def __init__(self, k: int):
        self.k, self.keys, self.losers = k, [None] * k, [-1] * max(1, k)

    def _beats(self, a: int, b: int) -> bool:
        if b == -1:
            return False
        if a == -1:
            return True
        ka, kb = self.keys[a], self.keys[b]
        return kb is None or (ka is not None and (ka, a) < (kb, b))

    def build(self) -> None:
        """All matches anew: what a refill of any place but the winner's asks for. An empty place (-1) wins, so that first matches wait for their opponents."""
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            node, winner = (i + self.k) // 2, i
            while node > 0:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
                if winner == -1:
                    break
            self.losers[0] = winner

    def winner(self) -> int:
        return self.losers[0]

    def replace(self, key: tuple | None) -> None:
        """The winner's next key."""
        w = self.losers[0]
        self.keys[w] = key
        node, winner = (w + self.k) // 2, w
        while node > 0:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner


class Merge:
    """Merges sorted runs whose blocks come in the order of their first keys: what is below a block's first key can go before it is taken in.

    So of each run only the blocks are held that the merge has reached, whatever the runs' lengths.
    """

    def __init__(self, fan_in: int):
        self.tree, self.rows, self.slots = LoserTree(fan_in), [deque() for _ in range(fan_in)], {}

    def until(self, key: tuple | None) -> Iterator[tuple]:
        """Rows below a key, or all."""
        tree = self.tree
        while tree.k and tree.keys[w := tree.winner()] is not None and (key is None or tree.keys[w] < key):
            own = self.rows[w]
            yield own.popleft()
            tree.replace(_order(own[0]) if own else None)

    def take(self, run: int, block: list[tuple]) -> None:
        slot = self.slots.setdefault(run, len(self.slots))
        self.rows[slot] += block
        if self.tree.keys[slot] is None:
            self.tree.keys[slot] = _order(self.rows[slot][0])
            self.tree.build()


_PLACE = "area int, nth_run int, block int, at int, f_url string, f_captured string, f_id long"
_PLACED = f"{_INDEX}, {_PLACE}"


class _Cut:
    """Rows of one run of one range, numbered by block and place, with the first key of their block."""

    def __init__(self, area: int, run: int, size: int):
        self.area, self.run, self.size, self.n, self.first = area, run, size, 0, ()

    def place(self, row: tuple) -> tuple:
        if self.n % self.size == 0:
            self.first = row[:3]
        self.n += 1
        return (*row, self.area, self.run, (self.n - 1) // self.size, (self.n - 1) % self.size, *self.first)


def histories(runs: DataFrame) -> DataFrame:
    """Index rows in global order of URL key, capture date and id, by merges of sorted runs: FAN_IN at once, pass after pass.

    Rows are dealt to ranges of keys first, so that tasks are of even size; ranges follow date, id and place too, so that a URL, or an id, with very many captures is
    spread over several. In a range, each run is cut into blocks, and a merge reads the blocks of its runs in the order of their first keys: it holds
    FAN_IN * BLOCK_ROWS rows or so, whatever the number and length of runs. Each pass is a written table.
    """
    n = runs.count()
    areas = max(1, -(-n // RANGE_ROWS))
    key = ["url_key", "captured", F.asc_nulls_first("page_id")]
    schema = arrow_schema(_PLACED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area, own = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for row in rows_of(batch):
                if own is None or own.run != row[-1]:
                    own = _Cut(area, row[-1], BLOCK_ROWS)
                out.append(own.place(row[:-1]))
            yield batch_of(out, schema)

    # runs are numbered by their files' names
    names = runs.select(F.col("run").alias("name")).distinct()
    numbers = written(running_sums(names.withColumn("number", F.lit(1).cast("long")), [], [F.col("name")], ["number"], "warc-names").select("name", (F.col("number") - 1).cast("int").alias("run_number")), "warc-runs")
    n_runs = numbers.count()
    # files hold about as many rows each, so that none is a hot one
    numbered = runs.join(numbers, F.col("run") == F.col("name")).select(*_INDEX_SCHEMA.names, "run_number")
    ranged = numbered.repartitionByRange(areas, "url_key", "captured", "page_id", "run", "member", "offset").sortWithinPartitions("run_number", *key, "member", "offset")
    table = written(ranged.mapInArrow(cut, _PLACED), "warc-blocks")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, merge, block, of, out = None, None, None, [], None, []

        def taken() -> None:
            """The block that has been read, once what lies before it has gone."""
            if block:
                out.extend(own.place(r) for r in merge.until(_order(block[0])))
                merge.take(of[0], block)

        for batch in batches:
            for row in rows_of(batch):
                *index, area, run, number, _, _, _, _ = row
                if (area, run // FAN_IN) != group:
                    taken()
                    if merge:
                        out.extend(own.place(r) for r in merge.until(None))
                    group, own, merge, block, of = (area, run // FAN_IN), _Cut(area, run // FAN_IN, BLOCK_ROWS), Merge(FAN_IN), [], None
                if (run, number) != of:
                    taken()
                    block, of = [], (run, number)
                block.append(tuple(index))
                if len(out) > 10_000:
                    yield batch_of(out, schema)
                    out.clear()
        taken()
        if merge:
            out.extend(own.place(r) for r in merge.until(None))
        yield batch_of(out, schema)

    order = ["f_url", "f_captured", F.asc_nulls_first("f_id"), "nth_run", "block", "at"]
    group = F.floor(F.col("nth_run") / FAN_IN).cast("int")
    while n_runs > FAN_IN:
        table = written(table.repartition("area", group).sortWithinPartitions("area", group, *order).mapInArrow(merged, _PLACED), "warc-merged")
        n_runs = -(-n_runs // FAN_IN)
    last = table.repartitionByRange(areas, "area").sortWithinPartitions("area", *order).mapInArrow(merged, _PLACED)
    return last.select(*_INDEX_SCHEMA.names)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages to archives, reads them back and returns the merged histories, one row for each page: url_key, captured, page_id,
    payload_bytes, payload_digest, record_type and refers_to. Pages have no date of their own: `captured` is made up from the id, FIRST_CAPTURE and as many seconds.

    A null html is an empty payload, a null url an empty one; line breaks in a url are left out. A null id is an empty name:
    such a page revisits an equal payload that has an id. Of rows that repeat an id with equal payloads, all with the largest id are
    responses. Very long payloads are records like others. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit_bytes=min_revisit_bytes)
    found = written(index(pages.sparkSession, path), "warc-index")
    # a revisit's payload is that of the response with its digest
    sizes = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    revisits = found.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.col("full"))
    whole = found.where("record_type = 'response'").unionByName(revisits.drop("full")).select(*_INDEX_SCHEMA.names)
    return histories(whole).drop("run", "member", "offset")
