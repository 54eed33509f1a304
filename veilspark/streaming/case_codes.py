"""Person codes of a case, carried from document to document in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.patterns import PERSON_CODES

CODED = "case_id long, doc_id long, name string, code string"


def code_of(rank: int) -> str:
    lap, at = divmod(rank - 1, len(PERSON_CODES))
    return PERSON_CODES[at] + (str(lap + 1) if lap else "")


def _carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # Names of the case in the order met; the state is as large as the case has persons, not documents.
    names = list(state.get[0]) if state.exists else []
    known = {n: i for i, n in enumerate(names, 1)}
    rows = pd.concat(list(frames)).sort_values(["doc_id", "start"], kind="stable")
    out = []
    for doc, name in zip(rows["doc_id"], rows["name"], strict=True):
        if name not in known:
            names.append(name)
            known[name] = len(names)
        out.append((int(key[0]), int(doc), name, code_of(known[name])))
    state.update((names,))
    yield pd.DataFrame(out, columns=["case_id", "doc_id", "name", "code"])


def coded_stream(mentions: DataFrame) -> DataFrame:
    """`mentions` (case_id, doc_id, start, name), a stream: each with its code, the same over all batches of a case.

    A mention that comes late takes a code when it comes; codes that were given never change.
    """
    return mentions.groupBy("case_id").applyInPandasWithState(_carry, CODED, "names array<string>", "append", GroupStateTimeout.NoTimeout)
