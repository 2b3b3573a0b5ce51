"""Schemas of the parsed tables."""

from __future__ import annotations

META = "array<struct<key:string,value:string>>"
TERM_REFS = "array<struct<name:string,slug:string,domain:string>>"
COMMENTS = (
    "array<struct<comment_id:bigint,author:string,author_email:string,author_url:string,author_ip:string,date:string,date_gmt:string,"
    f"content:string,approved:string,type:string,parent:string,user_id:bigint,commentmeta:{META}>>"
)
POST_STRINGS = [
    "post_title", "guid", "post_author", "post_content", "post_excerpt", "post_date", "post_date_gmt", "post_modified", "post_modified_gmt", "link", "pub_date",
    "comment_status", "ping_status", "post_name", "status", "post_type", "post_password", "attachment_url",
]
POST_NUMBERS = ["post_id", "post_parent", "menu_order", "is_sticky"]
ITEM = ", ".join([*(f"{c} string" for c in POST_STRINGS), *(f"{c} bigint" for c in POST_NUMBERS), f"terms {TERM_REFS}", f"postmeta {META}", f"comments {COMMENTS}", "failed_casts map<string,string>", "error string"])
AUTHORS = "array<struct<author_id:bigint,author_login:string,author_email:string,author_display_name:string,author_first_name:string,author_last_name:string>>"
TERMS = f"array<struct<phase:int,ord:int,term_id:bigint,taxonomy:string,slug:string,parent_slug:string,name:string,description:string,termmeta:{META}>>"
CHANNEL = f"authors {AUTHORS}, terms {TERMS}, error string"
