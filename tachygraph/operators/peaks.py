"""Beats from signals: detection in chunks, refinement, and distinct beats of a record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tachygraph.functions.peaks import detect, refine


def auto_label(chunks: DataFrame, method: str = "engzee") -> DataFrame:
    """(record_id, sample): distinct refined peaks of signal chunks (record_id, freq, start_sample, raw)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            records, samples = [], []
            for r in pdf.itertuples():
                signal = np.asarray(r.raw, float)
                got = refine(signal, detect(signal, r.freq, method)) + r.start_sample
                samples += got.tolist()
                records += [r.record_id] * len(got)
            yield pd.DataFrame({"record_id": records, "sample": samples})

    return chunks.select("record_id", "freq", "start_sample", "raw").mapInPandas(run, f"record_id {dict(chunks.dtypes)['record_id']}, sample long").distinct()
