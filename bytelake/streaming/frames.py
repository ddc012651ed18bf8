"""Patches as a stream of frames: reassembly with state, whatever the order and however often a frame comes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "pair_id long, frames int, total_len long, total_crc32 long, patch binary"
STATE = "frames map<int,binary>"


def reassemble(stream: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """A row for each patch once all its frames are there.

    stream: (pair_id, frame_no, frames, payload, crc32). A frame whose payload fails its CRC is ignored, of repeated
    valid frames the last counts. State is one patch a key, spread by pair_id, and is dropped with the last frame. What is
    incomplete, or begun again by a frame repeated after that, is dropped when no frame has come for ``patience_ms``;
    without it such state stays, as suits a stream that is read to its end once (a timeout would keep that from ending).
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[int, bytes] = dict(state.get[0]) if state.exists else {}
        total = None
        for part in parts:
            for no, n, payload, crc in zip(part["frame_no"], part["frames"], part["payload"], part["crc32"], strict=True):
                total = int(n)
                if zlib.crc32(bytes(payload)) == crc:
                    held[int(no)] = bytes(payload)
        if total is not None and len(held) == total:
            state.remove()
            patch = b"".join(held[i] for i in range(total))
            yield pd.DataFrame({"pair_id": [key[0]], "frames": [total], "total_len": [len(patch)], "total_crc32": [zlib.crc32(patch)], "patch": [patch]})
        else:
            state.update((held,))
            if patience_ms:
                state.setTimeoutDuration(patience_ms)

    return stream.groupBy("pair_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if patience_ms else GroupStateTimeout.NoTimeout)
