"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from gossamer.llm.iblt import op9_iblt
from gossamer.llm.line_dedup import op2_line_dedup
from gossamer.llm.packing import op7_packing
from gossamer.llm.quality import op6_quality
from gossamer.llm.secrets import ORACLE as SECRETS_SQL
from gossamer.llm.secrets import op4_secrets
from gossamer.llm.sentencepiece_viterbi import op8_sentencepiece
from gossamer.llm.sharding import op10_sharding
from gossamer.llm.simhash import op3_simhash
from gossamer.llm.toxicity import op1_toxicity
from gossamer.llm.url_filter import op5_url_filter

QUERIES = {"op1_toxicity": op1_toxicity, "op2_line_dedup": op2_line_dedup, "op3_simhash": op3_simhash, "op4_secrets": op4_secrets, "op5_url_filter": op5_url_filter, "op6_quality": op6_quality, "op8_sentencepiece": op8_sentencepiece, "op9_iblt": op9_iblt, "op7_packing": op7_packing, "op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {"op4_secrets": SECRETS_SQL}
