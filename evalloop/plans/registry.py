"""Name -> (Spark query, DuckDB oracle or None).  The driver contract reads this."""

from __future__ import annotations

from evalloop.plans import oracle as oq
from evalloop.plans import queries as q

# name: (spark callable, oracle SQL builder or None for a rows-only check)
REGISTRY = {
    "final_answer_extract": (q.final_answer_extract, oq.q_final_answer_extract),
    "answer_normalise": (q.answer_normalise, oq.q_answer_normalise),
    "judge_candidates": (q.judge_candidates, oq.q_judge_candidates),
    "pass_at_k": (q.pass_at_k, oq.q_pass_at_k),
    "stats_rollup": (q.stats_rollup, oq.q_stats_rollup),
    "bad_cases": (q.bad_cases, oq.q_bad_cases),
    "resume_anti_join": (q.resume_anti_join, oq.q_resume_anti_join),
    "last_wins": (q.last_wins, oq.q_last_wins),
    "compare_rounds": (q.compare_rounds, oq.q_compare_rounds),
    "round_history": (q.round_history, oq.q_round_history),
    "dataset_counts": (q.dataset_counts, oq.q_dataset_counts),
    "benchmark_build": (q.benchmark_build, oq.q_benchmark_build),
    "training_build": (q.training_build, oq.q_training_build),
    "sample_per_dataset": (q.sample_per_dataset, oq.q_sample_per_dataset),
    "dataset_select": (q.dataset_select, oq.q_dataset_select),
    "head_limit": (q.head_limit, oq.q_head_limit),
    "strip_think": (q.strip_think, oq.q_strip_think),
    "unwrap_tags": (q.unwrap_tags, oq.q_unwrap_tags),
    "three_sections": (q.three_sections, oq.q_three_sections),
    "qa_parse": (q.qa_parse, oq.q_qa_parse),
    "synthetic_accept": (q.synthetic_accept, oq.q_synthetic_accept),
    "tolerant_json": (q.tolerant_json, oq.q_tolerant_json),
    "error_profile": (q.error_profile, oq.q_error_profile),
    "near_dup_pairs": (q.near_dup_pairs, oq.q_near_dup_pairs),
    "decontaminate": (q.decontaminate, oq.q_decontaminate),
    "near_dup_classes": (q.near_dup_classes, oq.q_near_dup_classes),
    "decontaminate_links": (q.decontaminate_links, oq.q_decontaminate_links),
    "merge_dedup": (q.merge_dedup, oq.q_merge_dedup),
    "merge_training": (q.merge_training, oq.q_merge_training),
    "prompt_table": (q.prompt_table, oq.q_prompt_table),
    "training_prompts": (q.training_prompts, oq.q_training_prompts),
    "attribution_prompts": (q.attribution_prompts, oq.q_attribution_prompts),
    "generation_prompts": (q.generation_prompts, oq.q_generation_prompts),
    "validate_rows": (q.validate_rows, oq.q_validate_rows),
    "validate_summary": (q.validate_summary, oq.q_validate_summary),
    "judge_array_form": (q.judge_array_form, oq.q_judge_array_form),
    "attribution_job": (q.attribution_job, oq.q_attribution_job),
    "generation_job": (q.generation_job, oq.q_generation_job),
    "incremental_judge": (q.incremental_judge, oq.q_incremental_judge),
    "loop_two_rounds": (q.loop_two_rounds, oq.q_loop_two_rounds),
    "flat_boxed": (q.flat_boxed, oq.q_flat_boxed),
    "response_text": (q.response_text, oq.q_response_text),
    "recover_user_text": (q.recover_user_text, oq.q_recover_user_text),
    "cot_prompts": (q.cot_prompts, oq.q_cot_prompts),
    "dataset_short_names": (q.dataset_short_names, oq.q_dataset_short_names),
    "flat_accuracy": (q.flat_accuracy, oq.q_flat_accuracy),
    "latest_checkpoint": (q.latest_checkpoint, oq.q_latest_checkpoint),
    "cot_job": (q.cot_job, oq.q_cot_job),
    "running_stats": (q.running_stats, oq.q_running_stats),
    "provenance": (q.provenance, oq.q_provenance),
    "difficulty_preset": (q.difficulty_preset, oq.q_difficulty_preset),
    "pick_one": (q.pick_one, oq.q_pick_one),
    "seeded_shuffle": (q.seeded_shuffle, oq.q_seeded_shuffle),
    "missing_shards": (q.missing_shards, oq.q_missing_shards),
    "union_columns": (q.union_columns, oq.q_union_columns),
    "judged_rows": (q.judged_rows, oq.q_judged_rows),
    "mixed_k_summary": (q.mixed_k_summary, oq.q_mixed_k_summary),
    "stripped_validation": (q.stripped_validation, oq.q_stripped_validation),
    "tolerant_log": (q.tolerant_log, oq.q_tolerant_log),
    "auto_reader": (q.auto_reader, oq.q_auto_reader),
    "appended_log": (q.appended_log, oq.q_appended_log),
    "manifest": (q.manifest, oq.q_manifest),
    "split_choice": (q.split_choice, oq.q_split_choice),
    "answer_values": (q.answer_values, oq.q_answer_values),
    "prompt_questions": (q.prompt_questions, oq.q_prompt_questions),
    "completions_to_predictions": (q.completions_to_predictions, oq.q_completions_to_predictions),
    "dataset_full": (q.dataset_full, oq.q_dataset_full),
    "validation_report": (q.validation_report, oq.q_validation_report),
    "redelivered_candidates": (q.redelivered_candidates, oq.q_redelivered_candidates),
}
