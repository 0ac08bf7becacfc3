"""DDL of the tables that operators exchange; order is never physical, so every table carries its ordinals."""

SIDE = "book string, page int, side string"
EVIDENCE = f"{SIDE}, source string, pass_order int, row_no int, text string, conf double, x int, y int, w int, h int"
LINE_EVIDENCE = "line_id string, source string, pass_order int, text string, conf double"
WORDS = "image int, block int, par int, line int, word_no long, left int, top int, width int, height int, conf string, text string"
TSV = "level string, page_num string, block_num string, par_num string, line_num string, word_num string, left string, top string, width string, height string, conf string, text string"
SIDE_IMAGE = "page int, side string, height int, width int, channels int, pixels binary"
CANDIDATE = "struct<source:string,kind:string,text:string,conf:double,scale:double,psm:int>"
EDIT = "struct<action:string,old:string,new:string,reason:string,sources:array<string>>"
AUDIT = f"id string, page int, side string, reasons array<string>, before string, after string, edits array<{EDIT}>, whole_candidates array<{CANDIDATE}>, line_candidates array<{CANDIDATE}>"
QUEUE = "item_id string, page int, side string, current string, output_line string, context string, reasons array<string>, candidates array<string>"
OP = "struct<kind:string,old:string,new:string,confidence:string>"
REPLY = "batch_no long, reply string"
