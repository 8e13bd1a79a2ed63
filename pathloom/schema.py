"""Schemas of events, checkpoints and flows. NULL stands for a missing key; payload and page_context are JSON text."""

ROLE = "struct<role:string,name:string>"
SELECTORS = f"struct<css:string,xpath:string,text:string,role:{ROLE},testid:string,nth:struct<selector:string,index:int>,placeholder:string>"
TARGET = f"struct<selectors:{SELECTORS},tag:string,attributes:map<string,string>,text_content:string,bounding_box:struct<x:double,y:double,width:double,height:double>,is_in_iframe:boolean,iframe_selector:string>"
EVENT = f"event_id string, session_id string, tab_id string, sequence bigint, timestamp timestamp, event_type string, url string, target {TARGET}, payload string, page_context string, schema_version int"
ACTION = "struct<url:string,type:string,element:string>"
ELEMENT = f"struct<selectors:{SELECTORS},tag:string,text_content:string,is_visible:boolean,attributes:map<string,string>,computed_styles:map<string,string>>"
CHECKPOINT = f"checkpoint_id string, session_id string, trigger_event_id string, timestamp timestamp, url string, page_title string, visible_elements array<{ELEMENT}>, click_context array<{ELEMENT}>"

#: Order of the events of a session.
ORDER = ["timestamp", "sequence", "event_id"]

# Event types that are left out of graph nodes, of fingerprints, and that a look ahead passes over.
NODE_SKIP = ["scroll", "hover", "focus", "api_request", "api_error", "page_load"]
FINGERPRINT_SKIP = ["scroll", "hover", "focus", "blur", "navigation", "input", "change", "submit", "api_request", "api_error", "page_load"]
PEEK_SKIP = [t for t in FINGERPRINT_SKIP if t != "navigation"]
# Roles that identify an element without a name.
STRUCTURAL_ROLES = [
    "navigation", "main", "banner", "contentinfo", "complementary", "form", "region", "search", "alert", "alertdialog", "dialog", "log", "status", "timer",
    "toolbar", "menu", "menubar", "tablist", "tree", "treegrid", "grid", "table", "list", "heading", "img", "figure", "separator", "group",
]
REDACTED, REPLACEMENT = "[REDACTED]", "TestPass123!"
