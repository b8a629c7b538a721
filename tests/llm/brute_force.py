"""The test that compares each query without SQL with brute force or with a law
it must keep, as (module of tests/llm, test)."""

TESTS = {
    "op1_license_scan": ("test_llm", "test_every_license_line_of_the_tables_is_found"),
    "op2_sentencepiece": ("test_llm", "test_sentencepiece_round_trip_and_law"),
    "op3_topk_search": ("test_llm", "test_search_is_exact"),
    "op4_url_filters": ("test_llm", "test_url_rules_are_mined"),
    "op5_html_extraction": ("test_llm", "test_html_keeps_every_container"),
    "op6_quality_rules": ("test_llm", "test_quality_base_counts"),
    "op7_language_id": ("test_llm", "test_held_out_accuracy"),
    "op8_suffix_dedup": ("test_llm", "test_repeated_spans"),
    "op9_ngram_jaccard": ("test_llm", "test_jaccard_components"),
    "op10_mixing": ("test_llm", "test_mixing_meets_its_targets"),
    "pipeline": ("test_pipeline", "test_stages_by_brute_force"),
}
