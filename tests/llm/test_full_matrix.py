import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tidewake.llm import token_matrix as tm
from tidewake.llm.tokens import document_ids


def test_query_returns_the_matrices(spark, tmp_path):
    texts = ["one ship", "two harbours " * 900, "", None]
    pq.write_table(pa.table({"doc_id": pa.array(range(4), pa.int64()), "text": texts, "lang": ["en"] * 4, "source": ["x"] * 4, "n_chars": pa.array([0] * 4, pa.int64())}), f"{tmp_path}/documents.parquet")
    rows = tm.op9_token_matrix(spark, str(tmp_path)).collect()
    ids, positions = tm.read_matrix(rows)
    seen = {}
    for k, r in enumerate(rows):
        assert (zlib.crc32(bytes(r.ids)), zlib.crc32(bytes(r.positions))) == (r.ids_crc32, r.positions_crc32)
        for d, at, lo, hi in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            seen.setdefault(d, {})[at] = ids[k, lo:hi]
            assert list(positions[k, lo:hi]) == list(range(hi - lo))
    for d, t in enumerate(texts):
        assert np.array_equal(np.concatenate([v for _, v in sorted(seen[d].items())]), document_ids(t))
