"""Fixed schemas; nothing is inferred."""

SAMPLES = "song_id long, sample_rate int, samples array<float>"
CHUNKS = "song_id long, sample_rate int, chunk_no int, first_frame int, n_frames int, samples array<float>"
PEAKS = "song_id long, t int, f int, amp float"
SONGS = ("id long, source string, source_id string, title string, artist string, album string, duration_s double, "
         "file_path string, content_hash string, created_at timestamp")
SONG_INDEXES = "song_id long, index_name string, version string, item_count long, indexed_at timestamp, batch_id string"
FINGERPRINTS = "hash int, song_id long, anchor_time int, version string, batch_id string"
TRACKS = "track_id long, title string, artist string, album string, genre string, subset string, duration_s double"
CANDIDATE = "struct<song_id:bigint,offset_frames:int,aligned_matches:bigint>"
EVAL_RECORDS = ("kind string, source_track string, split string, condition string, clip_s int, true_song_id long, true_start_s double, "
                "best_song_id long, aligned long, runner_up long, confidence double, offset_s double, query_hashes long, db_hits long, "
                "t_fingerprint_ms double, t_lookup_ms double, t_score_ms double")
