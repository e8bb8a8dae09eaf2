"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidefold.llm import imatch, lines, mixing, neighbours, packing, pii, quality, repeats, simhash, warc

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_imatch": imatch.op2_imatch,
    "op3_mix": mixing.op3_mix,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_pack": packing.op5_pack,
    "op6_lines": lines.op6_lines,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": quality.op8_quality,
    "op9_personal": pii.op9_personal,
    "op10_warc": warc.op10_warc,
}
SQL = {"op3_mix": mixing.OP3_SQL, "op4_neighbours": neighbours.OP4_SQL, "op6_lines": lines.OP6_SQL, "op10_warc": warc.OP10_SQL}
