"""Explicit schemas of the store's tables and of nested artifacts; nothing is inferred."""

from __future__ import annotations

TABLES = {
    "videos": "video_id string, url string, title string, channel string, duration_s double, first_seen_at timestamp",
    "runs": "run_id string, video_id string, mode string, status string, config_hash string, manifest string, started_at timestamp, ended_at timestamp",
    "clips": "clip_id string, video_id string, idx int, aspect string, start_s double, end_s double, duration_s double, total_score double, hook_type string, hook_line string, transcript_text string, selected_reason string",
    "hook_scores": "clip_id string, criterion string, raw double, score double, weight double, method string, rationale string",
    "posts": "post_id string, clip_id string, variant string, platform string, text string, hashtags array<string>, tracking_url string, status string, mode string, scheduled_at timestamp, rationale map<string,string>",
    "metrics": "metric_id string, post_id string, window string, collected_at timestamp, impressions bigint, reach bigint, views bigint, likes bigint, comments bigint, shares bigint, saves bigint, clicks bigint, completion_rate double, hook_retention_3s double, engagement_rate double, ctr double, retention_curve array<struct<x:double,y:double>>, provenance string, provenance_detail map<string,string>",
    "hook_priors_snapshot": "snapshot_id string, run_id string, created_at timestamp, hook_type string, n_eff double, y_bar double, y_hat double, sigma double, multiplier double, sampled_multiplier double, params string",
    "seen_videos": "video_id string, channel string, seen_at timestamp",
}
KEYS = {"videos": ["video_id"], "runs": ["run_id"], "clips": ["clip_id"], "hook_scores": ["clip_id", "criterion"], "posts": ["post_id"], "metrics": ["metric_id"], "hook_priors_snapshot": ["snapshot_id"], "seen_videos": ["video_id"]}
TRANSCRIPT = "segments array<struct<id:bigint,start:double,end:double,text:string,words:array<struct<w:string,start:double,end:double,p:double>>>>"
#: Values a column may hold.
CHECKS = {"metrics": ("provenance", ("REAL", "SIMULATED", "MIXED")), "clips": ("aspect", ("9:16", "16:9", "1:1"))}
