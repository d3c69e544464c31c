"""The queries of this subpackage and the SQL that some of them are held against."""

from ablatrix.llm.debruijn import OP13_SQL, op13_debruijn
from ablatrix.llm.decontaminate import OP10_SQL, op10_decontaminate
from ablatrix.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from ablatrix.llm.fim import OP11_SQL, op11_fill_in_middle
from ablatrix.llm.html_text import op3_html_text
from ablatrix.llm.language import op5_language_id
from ablatrix.llm.lattice import op8_lattice_lm
from ablatrix.llm.packing import op2_packing
from ablatrix.llm.quality import op7_quality
from ablatrix.llm.secrets import op4_secrets
from ablatrix.llm.simhash import op9_simhash
from ablatrix.llm.spelling import OP12_SQL, op12_spelling
from ablatrix.llm.suffixes import op6_suffix_dedup

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_packing": op2_packing,
    "op3_html_text": op3_html_text,
    "op4_secrets": op4_secrets,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling": op12_spelling,
    "op13_debruijn": op13_debruijn,
}

SQL = {"op1_exact_dedup": OP1_SQL, "op10_decontaminate": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_spelling": OP12_SQL, "op13_debruijn": OP13_SQL}
