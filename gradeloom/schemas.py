"""Schemas of the domain's facts and dimensions."""

ROSTER = "roll_no string, name string, email string, program string, extra map<string,string>"
ANSWER_KEY = "q_no int, answer string, marks double, dropped boolean"
RUBRIC = "q_no int, question_text string, rubric string, model_answer string, max_marks double"
MANIFEST = """exam_id string, schema_version int, num_pages int, page struct<width_mm:double,height_mm:double>, bubble_radius_mm double,
 mcq_block array<struct<page:int,q_no:int,x_mm:double,y_mm:double,options:array<string>>>,
 numerical_block array<struct<q_no:int,page:int,positions:int,x_mm:double,y_mm:double,digit_pitch_mm:double,position_pitch_mm:double,max_marks:double,orientation:string>>,
 written_block array<struct<page:int,q_no:int,x_mm:double,y_mm:double,width_mm:double,height_mm:double,max_marks:double,lines:int>>"""
OCR = "struct<text:string,confidence:double,cells:array<struct<digit:string,p:double,probs:map<string,double>>>,selector:map<string,struct<fill:double,ink:double>>>"
DECISION = "entity long, action string, ts timestamp, seq long, n int, slot int"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
