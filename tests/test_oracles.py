import os

import duckdb
import pytest

from chronomotif import queries

SF = "/root/testdata/sf0.001"
#: Some of each kind.
SOME = """motif_count_triangle motif_judge_4_path motif_instances_4_cycle motif_completions_4_path motif_modify_triangle motif_count_pruned_bitriangle is_motif_own_windows
multi_motif_judge first_link_unlink_after edge_snapshots picked_edge graph_features component_labels dataset_stats gen_er_events gen_contain_positive gen_contain_negative gen_is_motif
prompt_full prompt_with_examples prompt_config_suffix parse_quads_sorted parse_quads_set parse_two_ints parse_names parse_name_counts parse_name_times score_sort score_what_edges score_link
score_reverse score_contain score_modify score_multi_judge score_multi_count score_first_time qa_sort_edge qa_what_edges qa_multi_motif_count eval_results eval_result_lists run_status
run_averages result_rates tool_detect_motifs_counts tool_modify_to_contain_motif tool_detect_edges_existence_at_time route_rule""".split()


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = db.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    plain = lambda df: df.astype({c: "float64" for c in df.columns if df[c].dtype.kind in "iuf"})
    assert rows(plain(got)) == rows(plain(want))


def test_published_counts(spark):
    te = queries.te_of(spark, SF)
    from chronomotif.operators import motifs

    assert motifs.count(te, "triangle").groupBy().sum("n_instances").first()[0] == 13
    assert motifs.count(te, "3-star").groupBy().sum("n_instances").first()[0] == 59
    assert motifs.count(te, "bitriangle", mode="monomorphism").groupBy().sum("n_instances").first()[0] == 39
