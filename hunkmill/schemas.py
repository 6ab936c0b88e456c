"""Schemas of the tables that the engine passes around. The *_ord columns carry the order that Spark does not keep."""

CHANGES = "split_id string, change_ord int, change_id string, file string, hunk_id int, type string, line_start int, line_end int, content string, added_lines int, deleted_lines int, language string"
SYMBOLS = "split_id string, change_id string, sym_ord int, name string, type string, file string, line int, role string, package string, qualified_name string, scope string"
IMPORTS = "split_id string, change_id string, alias string, path string"
DEPS = "split_id string, dep_ord int, source string, target string, type string, strength double, reason string"
ATOMIC_GROUPS = "split_id string, group_ord int, group_id string, reason string, change_ids array<string>"
SEMANTIC_GROUPS = "split_id string, group_ord int, group_id string, name string, description string, cohesion_score double, change_ids array<string>"
PATCHES = "split_id string, patch_id int, name string, description string, changes array<string>, depends_on array<int>, rationale string, size_lines int, warnings array<string>"
ANNOTATIONS = "split_id string, patch_id int, file_path string, hunk_header string, start_line int, end_line int, description string"

CHANGE_TYPES = ("add", "modify", "delete")
DEPENDENCY_TYPES = ("defines_uses", "import", "call_chain", "modifies_uses", "type_dependency")
SPLIT_METADATA = "generated_at string, total_patches int, goal_summary string, state string, deleted_at string, repository struct<name:string,path:string,branch:string>, pr struct<owner:string,repo:string,number:int>, patches array<struct<id:int,name:string,filename:string,description:string,category:string,priority:int,files:array<string>,depends_on:array<int>,state:string>>"
REVIEW = "id string, title string, status string, repository string, archived boolean, created_at string, summary string, issues array<struct<file:string,line:int,severity:string,message:string>>"
PULL = "number int, title string, author string, state string, updated_at string, repo string, owner string, additions int, deletions int, changed_files int"
