"""Schemas of the inputs: recognition logs, manifests, assessments.

Logs differ by engine and status, so one superset is read and absent fields are null.
"""

from __future__ import annotations

BLOCK = "struct<polygon: array<array<double>>, confidence: double, label: string, raw_label: string, reading_order: int, html: string, skipped: boolean, error: boolean, bbox: array<double>>"

RECOGNITION = f"""
input_path string, relative_input_path string, status string, raw_text string, text string,
suspicious_output boolean, suspicious_reason string, telugu_character_count int, elapsed_seconds double, error string,
tesseract_version string, language string, psm int, oem int, ocr_mode string, surya_version string,
surya_response struct<blocks: array<{BLOCK}>, image_bbox: array<double>>"""

MANIFEST = "page_key string, split string, writer_id string, page_id string, image_index string, image_path string, vocab_id string, ground_truth_text string, word_label_path string, page_label_path string"

SELECTED_MAPPING = "image_path string, vocab_id string, label string"

USAGE = "struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>"

PAGE = "page_key string, split string, writer_id string, page_id string, ocr_text string, ocr_regions array<string>, completed_words bigint, expected_words bigint, missing_or_error_words bigint"

DETECTION = "struct<region_index: int, error: string, correction: string, reason: string>"

ASSESSMENT = f"{PAGE}, status string, ocr_model string, input_kind string, source_results string, prompt_version string, model string, elapsed_seconds double, response_id string, usage {USAGE}"
FLUENCY = f"{ASSESSMENT}, score int, reason string, error_examples array<string>, rejected_error_example_count int"
DETECTIONS = f"{ASSESSMENT}, detected_error_count int, flagged_region_count int, rejected_detection_count int, detections array<{DETECTION}>, formatted_corrections array<string>"

IMPACT = "comparison string, level string, metric string, model string, baseline_mean double, candidate_mean double, pairs int"
