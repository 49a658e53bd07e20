"""The corpus operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .huffman import op4_token_ids
from .language import op6_language_id
from .lattice import op8_lattice_dedup
from .licenses import op5_license_scan
from .mixing import op10_mixing
from .packing import op2_packing
from .quality import op3_quality
from .simhash import op1_simhash_dedup
from .spotsigs import op7_spotsigs
from .urls import op9_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_packing,
        op3_quality,
        op4_token_ids,
        op5_license_scan,
        op6_language_id,
        op7_spotsigs,
        op8_lattice_dedup,
        op9_url_filter,
        op10_mixing,
    )
}
#: Each has a step that SQL cannot express (a trained model, a code, a lattice, dynamic programming) or that is too slow
#: there on whole tables; the tests hold them against brute force instead.
ORACLES: dict[str, str] = {}
