"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import OP4_SQL, op4_decontaminate
from .licenses import op8_licenses
from .line_dedup import OP3_SQL, op3_line_dedup
from .mpeg import op2_mpeg
from .packing import op5_packing
from .quality import op6_quality
from .ranking import OP13_SQL, op13_ranking
from .repair import op10_repair
from .setsketch import op9_setsketch
from .toxicity import op1_toxicity
from .url_rules import op7_url_rules
from .warc import OP12_SQL, op12_warc
from .whitening import op11_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mpeg": op2_mpeg,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_url_rules": op7_url_rules,
    "op8_licenses": op8_licenses,
    "op9_setsketch": op9_setsketch,
    "op10_repair": op10_repair,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_ranking": op13_ranking,
}
SQL = {"op3_line_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op12_warc": OP12_SQL, "op13_ranking": OP13_SQL}
