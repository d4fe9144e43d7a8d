"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .language import op3_language
from .lines import SQL as LINES
from .lines import op2_line_dedup
from .neighbours import op8_neighbours
from .pieces import op6_pieces
from .secrets import op9_secrets
from .simhash import op7_simhash
from .token_counts import op4_token_counts
from .token_files import op5_token_files
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_language": op3_language,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_pieces": op6_pieces,
    "op7_simhash": op7_simhash,
    "op8_neighbours": op8_neighbours,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
}

#: DuckDB SQL where SQL can express the query.
ORACLE: dict[str, str] = {"op2_line_dedup": LINES}
