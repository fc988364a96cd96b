"""Schemas of the canonical tables, as DDL."""

WORDS = "commentary_id string, ocr_run_id string, word_idx int, text string, x1 int, y1 int, x2 int, y2 int"
CONTAINERS = "commentary_id string, tc_type string, tc_idx int, tc_id string, w_start int, w_end int, attrs map<string,string>"
OCR_WORDS = "page_id string, line_idx int, word_idx int, text string, x1 int, y1 int, x2 int, y2 int"
VIA_PAGE = "struct<filename:string,size:bigint,regions:array<struct<shape_attributes:struct<name:string,x:int,y:int,width:int,height:int>,region_attributes:struct<label:string>>>,file_attributes:struct<is_ground_truth:struct<ocr:boolean,olr:boolean>>>"
VIA_PROJECT = f"_via_img_metadata map<string,{VIA_PAGE}>"
JSON_PAGE = "array<struct<words:array<struct<text:string,xyxy:array<int>>>>>"
SECTIONS = "array<struct<section_types:array<string>,section_title:string,start:string,end:string>>"
LEMLINK = "TOKEN string, LABEL string, ANCHOR_TEXT string, ANCHOR_TARGET string, RENDER string, SEG string, DOCUMENT_ID string"
INTERVALS = "array<struct<id:string,region_type:string,is_ocr_gt:boolean,section_types:array<string>,section_title:string,label:string,transcript:string,wikidata_id:string,anchor_target:string,shifts:array<int>,word_range:array<int>>>"
KINDS = ("pages", "lines", "regions", "sections", "entities", "sentences", "hyphenations", "lemmas")
CANONICAL = "id string, ocr_gt_page_ids array<string>, olr_gt_page_ids array<string>, ner_gt_page_ids array<string>, lem_link_gt_page_ids array<string>, lemlink_gt_page_ids array<string>, children struct<words:array<struct<text:string,bbox:string>>," + ",".join(f"{k}:{INTERVALS}" for k in KINDS) + ">"
LINE_PAIR = "ocr struct<line:string>, groundtruth struct<line:string>"
