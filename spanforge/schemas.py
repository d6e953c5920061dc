"""Table schemas, as DDL."""

MEDIA = "video_id string, url string, platform string, kind string, duration_s double"
HITS = "video_id string, timestamp_s double, text string, score int, triggers array<string>"
CAPTIONS = "video_id string, seq int, start_s double, end_s double, text string, lang string"
CANDIDATES = "video_id string, cand_seq int, start_s double, end_s double, source string, raw_triggers array<string>, texts array<string>, frame_timestamps array<double>, score_hint int"
EVIDENCE = "struct<frame_timestamps:array<double>,transcript_span:string,ocr_text:string,transcript_lang:string,signals_used:array<string>>"
SEGMENTS = f"video_id string, id string, start_s double, end_s double, ad_type string, confidence double, brand string, description string, evidence {EVIDENCE}, presentation string"
CANDIDATE = "struct<start_s:double,end_s:double,source:string,raw_triggers:array<string>,texts:array<string>,frame_timestamps:array<double>,score_hint:int>"
LIVE_TICKS = f"session_id string, now_s double, cands array<{CANDIDATE}>, is_end boolean"
FRAMES = "session_id string, now_s double, rois array<struct<roi_name:string,thumb:array<double>,text:string>>, hist array<double>, text string, is_end boolean"
SENSED_ROI = "struct<roi_name:string,raw_text:string,source_s:double,sensed:boolean,mae:double>"
SENSED = f"session_id string, now_s double, rois array<{SENSED_ROI}>, distance double, text string, is_end boolean"
SIGHTED = f"session_id string, now_s double, seen array<struct<roi_name:string,signature:string,text:string>>, cands array<{CANDIDATE}>, is_end boolean"
LASTING = "session_id string, now_s double, event string, roi_name string, signature string, first_seen double, last_seen double, n_seen long, text string"
LIVE_EVENTS = "session_id string, seq long, now_s double, event string, track int, start_s double, end_s double, status string, source string, roi string, signature string, triggers array<string>, texts array<string>, frame_timestamps array<double>, text string, score int"
_SEGMENT = f"struct<id:string,start_s:double,end_s:double,ad_type:string,confidence:double,brand:string,description:string,evidence:{EVIDENCE},presentation:string>"
_SOURCE = "struct<url:string,platform:string,kind:string,duration_s:double,processed_at:string>"
GOLD = f"policy_version string, videos array<struct<source:{_SOURCE},segments:array<{_SEGMENT}>>>"
PREDICTION = f"source {_SOURCE}, segments array<{_SEGMENT}>, stats struct<wall_clock_s:double,estimated_cost_usd:double,frames_sampled:int,frames_ocrd:int,ocr_wall_s:double,model_calls:int,llm_fallback:string>"
