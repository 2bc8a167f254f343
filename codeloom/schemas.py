"""Schemas of the parsed tables."""

from __future__ import annotations

CONST = "struct<type:string,value:string>"
DETAILS = f"array<struct<name:string,args:array<{CONST}>,kwargs:map<string,{CONST}>>>"
CALL = "struct<name:string,receiver:string,is_method_call:boolean,args_count:int,line:int>"
BRANCH = f"struct<condition:string,line:int,is_else:boolean,calls:array<{CALL}>>"
TYPES = "map<string,string>"
FUNCTION = (
    f"struct<qualified_name:string,name:string,type:string,class_name:string,line_start:int,line_end:int,docstring:string,"
    f"decorators:array<string>,decorator_details:{DETAILS},return_type:string,calls:array<{CALL}>,branches:array<{BRANCH}>,"
    f"local_types:{TYPES},parameter_types:{TYPES},call_assignments:{TYPES}>"
)
CLASS = "struct<name:string,qualified_name:string,bases:array<string>>"
IMPORT = "struct<module:string,name:string,alias:string,is_relative:boolean,level:int>"

#: What the parser emits for a file.
PARSED = (
    f"file_path string, module_path string, parse_error string, file_hash string, n_classes int, functions array<{FUNCTION}>, "
    f"classes array<{CLASS}>, imports array<{IMPORT}>, module_types {TYPES}"
)

NODE_TYPES = ("function", "method", "class")
ENTRY_TYPES = ("api_route", "celery_task", "signal_handler", "discovered")
ASYNC_TYPES = ("celery_delay", "celery_apply_async", "celery_chain", "celery_chord", "celery_group")
