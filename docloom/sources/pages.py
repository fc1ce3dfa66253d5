"""Page texts of PDF files.  Reading PDFs needs an optional library; a table of page texts does as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points cut off at the top and the bottom of a page.
MARGIN = 45


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the PDF files of a folder, whatever the case of their suffix, in the order of their paths."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.where(F.lower("path").endswith(".pdf")).orderBy("path")


def page_texts(files: DataFrame) -> DataFrame:
    """``source, page_num, text`` of pages with text: cropped, else by layout, else whole; unreadable files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        for number, page in enumerate(pdf.pages, 1):
                            body = page.crop((0, MARGIN, page.width, page.height - MARGIN))
                            text = body.extract_text() or body.extract_text(layout=True) or page.extract_text()
                            if text and text.strip():
                                rows.append((path.rsplit("/", 1)[-1], number, text))
                except Exception:  # noqa: BLE001  a broken file has no pages; the others still count
                    rows = []
                yield pd.DataFrame(rows, columns=["source", "page_num", "text"])

    return files.mapInPandas(run, "source string, page_num int, text string")
