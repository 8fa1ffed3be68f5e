"""Record schemas of the tables that pipelines read and write, as Spark DDL."""

QUESTION_A = "id string, question string, answer string, type string, level string, supporting_facts array<struct<title:string,sent_id:int>>, context_titles array<string>"
QUESTION_B = "id string, dataset string, question string, answer string, gold_titles array<string>, n_hops int"
QUESTION_NESTED = "id string, question string, answer string, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
QUESTION_PAIRS = "_id string, id string, question string, answer string, supporting_facts array<array<string>>"
PASSAGE = "chunk_id string, title string, text string"
VECTOR = "chunk_id string, embedding array<float>"
BOX = "chunk_id string, row_idx bigint, center array<float>, half_width double"
ANSWER = "id string, condition string, question string, gold_answer string, prediction string, type string, level string, retrieved_chunk_ids array<string>, error string, retrieval_scores array<double>"
LENS_EXTRAS = "point_chunk_ids array<string>, parent_pairs array<array<string>>, lens_log_scores array<double>, lens_contained_chunk_ids array<array<string>>, gold_chunk_ids array<string>"
SWEEP = "id string, condition string, f1 double, em double, pair_in_context boolean, n_chunks int"
INTERVAL = "point_estimate double, ci_low double, ci_high double, n_resamples int"
