"""Parsing in Arrow-batched workers: one tagged stream, split into entity, symbol and diagnostic frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import predicates as P
from codeloom.functions.hashing import body_minhash
from codeloom.operators.lineage import cut
from codeloom.schema import DROPPED, ENTITIES, SYMBOLS

#: Files whose numbers are summed by one task.
RUN = 4096
TAGGED = f"tag string, file_id long, seq int, {ENTITIES.replace('id long, kind', 'kind', 1).replace('file_id long, ', '')}, message string, severity string"
_COLUMNS = [c.split()[0] for c in TAGGED.replace("array<long>", "x").split(", ")]


def parse(contents: DataFrame) -> DataFrame:
    """Tagged rows of (id, path, lang, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codeloom.frontends import extract

        for f in frames:
            rows: list[dict] = []
            for file_id, lang, content, noisy in zip(f.id, f.lang, f.content, f.noisy, strict=True):
                note = lambda message, severity, file_id=file_id: rows.append({"tag": "d", "file_id": file_id, "seq": 0, "message": message, "severity": severity})
                if not lang:
                    note("unsupported language", "info")
                    continue
                try:
                    text = bytes(content).decode()
                except (UnicodeDecodeError, TypeError):
                    note("unreadable or not UTF-8", "error")
                    continue
                if noisy:
                    note("minified or generated", "warning")
                    continue
                entities, symbols, error = extract(lang, text)
                if error:
                    note(error, "warning")
                for i, e in enumerate(entities):
                    body = e.pop("body", None)
                    signature = body_minhash(body) if body else None
                    rows.append(e | {"tag": "e", "file_id": file_id, "seq": i, "body_minhash": signature and [x - (1 << 64) if x >> 63 else x for x in signature]})
                rows += [s | {"tag": "s", "file_id": file_id, "seq": i} for i, s in enumerate(symbols)]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("kind", "seq", "start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col", "file_id"):
                out[c] = out[c].astype("Int64")
            yield out.astype(object).where(out.notna(), None)

    noisy = P.is_minified(F.decode("content", "ISO-8859-1"))  # any bytes decode
    return contents.select("id", "lang", "content", noisy.alias("noisy")).mapInPandas(run, TAGGED)


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, symbols, diagnostics); ids follow file order, then reading order."""
    # kinds that aren't stored get no id: ids of kept and of newly parsed files are the same
    tagged = cut(tagged.filter((F.col("tag") != "e") | ~F.col("kind").isin(DROPPED)), "parsed")

    def numbered(tag: str) -> DataFrame:
        rows = tagged.filter(F.col("tag") == tag)
        # ranks inside a file, plus what earlier files have: files in runs of RUN, sums in each and over the runs
        sizes = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("file_id") / RUN))
        runs = sizes.groupBy("run").agg(F.sum("n").alias("all")).withColumn("one", F.lit(1))  # one row for RUN files
        earlier = runs.select("run", F.coalesce(F.sum("all").over(Window.partitionBy("one").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
        within = F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before = sizes.withColumn("within", within).join(earlier, "run").select("file_id", (F.col("within") + F.col("earlier")).alias("before"))
        inside = F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))
        return rows.withColumn("i", inside).join(before.select("file_id", "before"), "file_id").withColumn("id", (F.col("before") + F.col("i")).cast("long"))

    names = lambda ddl: [c.split()[0] for c in ddl.replace("array<long>", "x").split(", ")]
    entities = numbered("e").select(*names(ENTITIES))
    diagnostics = numbered("d").select("id", "file_id", "message", "severity")
    return entities, numbered("s").select(*names(SYMBOLS)), diagnostics
