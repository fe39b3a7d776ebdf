"""The registered queries of this package and the SQL that checks them."""
import corpus_pipeline
from voxelspark.llm.decontaminate import OP1_SQL, op1_benchmark_hits
from voxelspark.llm.factors import op9_lz_dedup
from voxelspark.llm.forest import op4_forest_groups
from voxelspark.llm.katz import op3_katz_scores
from voxelspark.llm.licences import op7_licence_scan
from voxelspark.llm.linejoin import op5_similar_lines
from voxelspark.llm.packing import op6_pattern_packing
from voxelspark.llm.prefixtrie import OP13_SQL, op13_prefix_trie
from voxelspark.llm.quality import OP8_SQL, op8_line_frequency
from voxelspark.llm.sequences import op2_token_files
from voxelspark.llm.simhash import op11_simhash_groups
from voxelspark.llm.suffixes import op10_suffix_dedup
from voxelspark.llm.zonemaps import OP12_SQL, op12_zone_clusters

QUERIES = {q.__name__: q for q in (
    op1_benchmark_hits, op2_token_files, op3_katz_scores, op4_forest_groups, op5_similar_lines, op6_pattern_packing,
    op7_licence_scan, op8_line_frequency, op9_lz_dedup, op10_suffix_dedup, op11_simhash_groups, op12_zone_clusters,
    op13_prefix_trie)} | {"pipeline": corpus_pipeline.run}
SQL = {"op1_benchmark_hits": OP1_SQL, "op8_line_frequency": OP8_SQL, "op12_zone_clusters": OP12_SQL, "op13_prefix_trie": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
