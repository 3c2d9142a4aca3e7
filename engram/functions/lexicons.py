"""Word lists that results depend on. Every operator takes its lists as parameters; these are the defaults.

The lists below are fixed values: results are only comparable if they are the same.
"""

from __future__ import annotations

# ---- fixed values ----
CHATTER = ["thank you", "thanks", "thx", "ok", "okay", "great", "perfect", "got it", "sounds good", "hello", "hi", "hey", "bye", "lol", "haha", "cool", "nice", "awesome", "sure", "yes please", "no thanks"]
SECRETS = [
    "api_key", "api-key", "apikey", "secret_key", "secret-key", "access_token", "access-token", "auth_token", "auth-token", "bearer ", "password=", "password: ", "passwd=",
    "private_key", "private-key", "begin rsa private key", "begin openvpn static key", "begin private key", "aws_secret_access_key", "client_secret",
]
PROBLEM_WORDS = [
    "how do i", "how to", "how can i", "what is the way to", "i need to", "i want to", "i'm trying to", "i am trying to", "why does", "why is", "why can't", "why cant",
    "error:", "exception:", "fails when", "panics when", "doesn't work", "does not work", "stuck on",
]
NOT_PROBLEMS = ["thank you", "thanks", "ok thanks", "got it", "sounds good", "that works", "perfect", "great", "awesome", "cool", "nice"]
INTERROGATIVES = ["who ", "what ", "when ", "where ", "why ", "how ", "is ", "are ", "can ", "do ", "does "]
TYPE_WORDS = {
    "profile": ["i am", "i'm", "my name", "i work", "i use", "i prefer", "i like", "i love", "i hate", "i live", "i'm based", "i'm from", "my role", "my job"],
    "preference": ["prefer", "always use", "never use", "should use", "favorite", "favourite", "convention", "style guide", "i like to", "i dislike", "tab indentation", "snake_case", "camelcase"],
    "interaction": ["today", "yesterday", "this morning", "right now", "let's", "let us", "in this chat", "earlier", "last time", "later today", "this week", "this session"],
    "knowledge": ["how to", "how do i", "error", "exception", "fix", "solution", "cause", "because", "the problem is", "root cause", "workaround", "deprecated"],
    "skill": ["tutorial", "guide", "recipe", "playbook", "step-by-step", "how-to", "snippet", "boilerplate", "template", "checklist", "command line", "cli ", "script", "workflow"],
    "experience": ["we tried", "we found", "our project", "in production", "lessons learned", "postmortem", "war story", "we hit", "we built", "our team", "we learned", "retrospective", "incident"],
}
VALUE_WORDS = [
    "error", "exception", "crash", "panic", "fix", "solve", "important", "critical", "security", "vulnerability", "deprecated", "migration", "production", "deployment",
    "config", "performance", "memory leak", "race condition", "deadlock",
]
TYPE_BIAS = {"knowledge": 0.95, "skill": 0.95, "profile": 0.85, "experience": 0.70, "preference": 0.65, "interaction": 0.40}
TYPE_TTL_SECONDS = {"knowledge": 2592000, "preference": 604800, "skill": 2592000, "experience": 1209600, "interaction": 86400, "profile": 2592000}
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "up", "about", "into", "through", "during", "before",
    "after", "above", "below", "between", "under", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
]
PAST_WORDS = ["上次", "以前", "曾经", "之前", "过去", "去年", "昨天", "上周", "上个月", "last", "before", "yesterday", "previously", "ago", "past", "earlier", "old"]
FUTURE_WORDS = ["下次", "将来", "打算", "计划", "将要", "即将", "未来", "明天", "下周", "下个月", "next", "upcoming", "plan", "planning", "will", "future", "tomorrow", "soon"]
FILE_ENDINGS = [".rs", ".go", ".ts", ".py", ".toml", ".json", ".yaml", ".md"]
POSITIVE_WORDS = ["开心", "高兴", "好开心", "快乐", "温暖", "信任", "喜欢", "爱", "感谢", "谢谢", "幸福", "安心", "欣慰", "期待", "依赖"]
NEGATIVE_WORDS = ["难过", "伤心", "生气", "讨厌", "害怕", "烦", "压力", "委屈", "失望", "痛苦", "焦虑", "愤怒", "孤独", "疲惫", "心累", "崩溃"]
PERSONA_MARKERS = [
    ("我不喜欢", "preference", True), ("我讨厌", "preference", True), ("我喜欢", "preference", False), ("我偏爱", "preference", False), ("我爱", "preference", False),
    ("我不要", "goal", True), ("我不肯", "goal", True), ("我要", "goal", False), ("我宁可", "goal", False), ("我是", "identity", False), ("我向来", "identity", False),
    ("我心里", "emotion", False), ("心里", "emotion", False), ("我害怕", "emotion", False), ("我难过", "emotion", False),
]
IMPACT_WORDS = [
    "kill", "attack", "strike", "murder", "cry", "laugh", "smile", "frown", "weep", "fear", "say", "ask", "reply", "shout", "whisper",
    "go", "come", "enter", "leave", "ride", "walk",
]
ARC_POSITIVE = ["仁", "义", "善", "宽", "厚", "谦", "智勇", "英雄", "忠", "慈"]
ARC_NEGATIVE = ["奸", "狡", "诈", "狠", "毒", "多疑", "善妒", "刚愎", "傲慢", "躁", "急", "残", "有勇无谋"]
EVENT_DEATHS = ["战死", "去世", "身亡", "阵亡", "死亡", "病逝", "病故", "殒命", "毙命", "驾崩", "圆寂", "陨落"]
DIALOG_MARKERS = ["曰：", "道："]
DIALOG_TO_WORDS = ["谓", "对"]
POEM_WORDS = ["诗", "词"]
DIALOG_ADDRESS = [
    (["主公", "陛下", "大王", "王上", "皇上", "天子"], "君臣"), (["丞相", "军师", "都督", "将军"], "君臣"), (["哥哥", "大哥", "义兄", "贤弟", "兄弟", "义弟"], "结义"),
    (["师父", "师傅", "师尊", "恩师"], "师徒"), (["夫人", "娘子", "贤妻", "拙荆"], "夫妻"), (["父亲", "父王", "爹爹", "岳父"], "父子"), (["母亲", "娘亲"], "母女"),
]
VERB_SETS = {
    "strong": ["attack", "rescue", "creation"], "action": ["speech", "movement", "emotion", "cognition", "transfer", "state", "intention", "preference"],
    "hostile": ["attack"], "friendly": ["rescue"],
}
# payload keys by which the newest fact of a type is found; the first that holds a string counts
KEYS = {
    "goal": ["goal", "content"],
    "preference": ["topic", "preference", "content"],
    "relationship": ["target", "with", "object", "content"],
    "identity": ["attribute", "identity", "key", "content"],
}
RESTATEMENTS = [
    ("你喜欢", "preference"), ("你偏好", "preference"), ("你想要", "goal"), ("你计划", "goal"), ("你打算", "goal"), ("你感到", "emotion"), ("你觉得", "emotion"), ("you like", "preference"),
    ("you prefer", "preference"), ("you want", "goal"), ("you plan", "goal"), ("you feel", "emotion"), ("the user likes", "preference"), ("the user prefers", "preference"), ("the user wants", "goal"),
]
DONE = ["done", "implemented", "replaced", "completed", "fixed", "完成", "替换", "修复"]
# ---- end of fixed values ----

#: Frequent letter runs of the driver's invented prose, to exercise the same operators on its tables.
DRIVER_PROBLEMS = ["tion", "with", "que"]
DRIVER_TYPES = {"profile": ["of the", "and of"], "preference": ["thing", "ring"], "interaction": ["with", "from"], "knowledge": ["tion", "the "], "skill": ["ion of", "able"], "experience": ["que", "der "]}
DRIVER_VALUE = ["tion", "with", "ing", "the ", "and ", "ment", "that"]
DRIVER_MARKERS = [("tion", "like"), ("with", "plan"), ("that", "feel"), ("thing", "like"), ("and", "want"), ("from", "belief")]
