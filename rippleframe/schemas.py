"""Explicit schemas of the engine's tables; nothing is inferred."""

INVENTORY = "path string, size long, modified_ns long, source string, content_hash string"
FILES = "path string, module string, is_package boolean, is_test boolean, size long, modified_ns long, content_hash string"
IMPORT_STRUCT = "struct<kind:string,module:string,name:string,level:int,api:string,package:string,fromlist:array<string>,reason:string>"
CHANGES = "kind string, path string, previous_path string, is_config boolean"

_PLACE = "line:int,col:int"
FACTS = (
    "path string, "
    f"imports array<struct<ordinal:int,kind:string,module:string,name:string,level:int,api:string,package:string,fromlist:array<string>,reason:string,{_PLACE}>>, "
    f"exports array<struct<ordinal:int,name:string,module:string,imported_name:string,level:int,wildcard:boolean,{_PLACE}>>, "
    f"fixtures array<struct<ordinal:int,name:string,autouse:boolean,scope:string,{_PLACE},params:array<string>>>, "
    f"requests array<struct<ordinal:int,kind:string,name:string,scope:string,{_PLACE}>>, "
    f"plugins array<struct<ordinal:int,name:string,{_PLACE}>>, "
    f"uncertainty array<struct<kind:string,{_PLACE}>>, "
    "error string"
)
EVIDENCE = f"dependent string, dependency string, stage int, seq long, kind string, line int, col int, import {IMPORT_STRUCT}, name string"
