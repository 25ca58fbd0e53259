"""Types of records, predictions and results. Readers always get one of these; nothing is inferred."""

from __future__ import annotations

STEP = "struct<step_id:string,op:string,text:string,latex:string,numbers:array<string>,text_template:string>"
ERROR = "struct<type:string,operator:string,mutation_site:string,causally_affected_nodes:array<string>,span:array<int>,severity:int,propagates:boolean,type_identifiable:string,ambiguous_cross_family:boolean>"
CHARACTER = "struct<i:int,row:int,char:string,bbox:array<double>,glyph_source:string>"
RENDER = (
    "struct<style_id:string,page:struct<w:int,h:int>,boxes_px:array<struct<step_id:string,bbox:array<double>>>,"
    "error_span_boxes_px:array<struct<error_ref:int,boxes:array<array<double>>,multiline:boolean>>,"
    f"char_boxes_px:map<string,array<{CHARACTER}>>,pseudo_writer_id:string,glyph_fallback_rate:double,char_id_alignment:string,pitch_mode:string>"
)
RECORD = (
    "sample_id string, pair_id string, problem struct<text_ja:string,grade:int,domain:string,generator:string>, "
    f"gold_solution array<{STEP}>, answer_key struct<final:string,verified_by:string>, "
    f"rubric struct<fn_id:string,weights:map<string,int>,text_ja:string>, injected_errors array<{ERROR}>, mutant_solution array<{STEP}>, "
    "transcript_gt struct<text:string,normalization:string>, score_gt struct<full:int,awarded:int>, control_flag struct<error_free:boolean>, "
    f"provenance struct<pipeline:string,gates_passed:array<string>,verbalizer:string>, render {RENDER}"
)
RELABEL = "sample_id string, type_identifiable string, subtype_retained boolean, ambiguous_cross_family boolean, type_legacy string, operator string"
PREDICTED = "struct<step_id:string,bbox:array<double>,type:string>"
PREDICTION = f"sample_id string, transcript string, errors array<{PREDICTED}>, score bigint, failure string"

#: Error types that surfaces cannot tell apart, by the family they fall into (fixed values).
FAMILY = {"概念/移項": "移項", "記法/移項符号": "移項", "概念/符号・乗算": "符号・乗算", "計算/符号": "符号・乗算"}
FAMILIES = tuple(dict.fromkeys(FAMILY.values()))
