"""Explicit schemas of the artifact tables. Readers use them and never infer."""

from __future__ import annotations

_KEYS = "channel string, video_id string"

SCHEMAS = {
    name: f"{_KEYS}, {ddl}"
    for name, ddl in {
        "shots": "idx int, start_frame int, end_frame int, start double, end double",
        "segments": "idx int, start double, end double, text string, speaker string",
        "words": "start double, end double, word string",
        "speaker_turns": "idx int, start double, end double, speaker string, text string, n_words int",
        "shot_similarity": "idx int, start double, end double, offset int, sim double",
        "shot_similarity_stats": "idx int, start double, end double, offset int, mean double, median double, max double",
        "audio_labels": "idx int, start double, end double, top3 array<struct<label string, prob double>>",
        "speaker_attrs": "idx int, start double, end double, speaker string, gender_pred string, gender_prob double, emotions array<struct<label string, prob double>>",
        "pos": "idx int, start double, end double, speaker string, tags array<struct<word string, upos string, xpos string, start_char int, end_char int>>, vector array<double>",
        "entities": "turn_idx int, pos int, text string, type string, start int, end int, wd_id string, wd_label string, disambiguation string, url string",
        "wikifier": "turn_idx int, qid string, title string, url string, ch_from int, ch_to int, page_rank double",
        "sentiment": "idx int, model string, sentence_vector array<double>, pred string, prob array<double>",
        "segment_sentiment": "start double, end double, text string, sentiment string, probs map<string, double>",
        "evaluative": "idx int, start double, end double, speaker string, label string, confidence string",
        "shot_density": "i int, t double, y double",
        "layout": "idx int, start double, end double, layout_cnt map<string, double>, layout_image_cnt double",
        "angle_level": "shot_idx int, i int, prediction string",
        "scale_movement": "idx int, start double, end double, scale string, cumulative_distance double, movement string",
        "face_detection": "face_id string, frame int, time double, delta_time double, bbox struct<x double, y double, w double, h double>, kps array<array<double>>, det_score double, embedding array<float>, landmark array<array<double>>",
        "track_frame": "track_id string, frame int, bbox array<double>, face_id string, embedding array<float>",
        "face_cluster": "face_id string, track_id string, cluster_id int",
        "asd_track": "track_id string, is_speaking boolean, speaking_ratio double, speaking_frames int, mean_score double, smoothed_scores array<double>",
        "face_emotion": "face_id string, frame int, time double, emotions map<string, double>",
        "face_gaze": "face_id string, frame int, time double, left_gaze_rad array<double>, right_gaze_rad array<double>, left_gaze_deg array<double>, right_gaze_deg array<double>",
        "srr_features": "turn_idx int, start_time double, end_time double, seg_feature array<double>, sw_feature array<double>",
        "roles": "turn_idx int, start_time double, end_time double, role_l0 string, role_l1 string",
        "situations": "turn_idx int, start_time double, end_time double, situation string",
        "vlm_labels": "task string, label string, label_idx int, t double, value int, original_response string",
        "turn_topics": "turn_index int, start double, end double, text string, topic string, words array<string>",
        "annotations": "tier string, start_ms bigint, end_ms bigint, value string",
        "nodes": "id string, type string, start_time double, end_time double, attrs map<string, string>",
        "edges": "src string, dst string, weight double, title string",
    }.items()
}
