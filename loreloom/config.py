"""Limits, thresholds, word lists and patterns.

They decide results, so they are stated as they are and can be overridden by
passing another value to the functions that use them.
"""

from __future__ import annotations

# --- chunking ---------------------------------------------------------------
CHUNK_CHARS = 1200
CHUNK_OVERLAP = 120
TABLE_ROW_CHARS = 12000
MAX_PAGES = 1000
MAX_TEXT_CHARS = 2_000_000
MAX_TABLE_ROWS = 50_000
MAX_TABLE_COLUMNS = 1000

# --- ranking ----------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
LIST_LENGTH = 150
SEMANTIC_MIN_EXTERNAL = 0.35
EVIDENCE_CHARS = 18_000

# --- near duplicates --------------------------------------------------------
NEAR_DUPLICATE_LEXICAL = 0.86
NEAR_DUPLICATE_VECTOR = 0.93
CONFLICT_SHAPE = 0.72
MIN_BLOCK_CHARS = 12

# --- graph ------------------------------------------------------------------
GRAPH_MAX_NODES = 200
GRAPH_MAX_EDGES = 400
GRAPH_MAX_HOPS = 3
GRAPH_MAX_PATHS = 100

# What the rows of a register state.  Nodes: name, type, role of the code, role of
# the name, and where a key holds: "shared" by all registers with the code, "coded"
# the same but never without a code, or within an organisation, line or event.
GRAPH_NODES = (
    ("asset", "asset", "asset", "asset_name", "coded"),
    ("order", "work_order", "work_order", "work_order", "shared"),
    ("line", "line", "line_id", "line", "organization"),
    ("station", "station", "station_id", "station", "line"),
    ("fault", "fault", "fault", "fault_name", "event"),
    ("issue", "issue", "issue", "issue_name", "event"),
    ("procedure", "procedure", "procedure", "procedure_name", "shared"),
    ("document", "document", "document", "document_name", "shared"),
)
# Relations: predicate, the first present of these nodes, object.
GRAPH_RELATIONS = (
    ("located_at", ("asset",), "station"),
    ("belongs_to_line", ("station",), "line"),
    ("has_work_order", ("asset",), "order"),
    ("has_fault", ("order", "asset"), "fault"),
    ("has_issue", ("order", "asset"), "issue"),
    ("follows_procedure", ("fault", "issue", "order", "asset"), "procedure"),
    ("references_document", ("procedure", "order", "asset"), "document"),
)

# --- page layout: fixed values, in units of the middle word height or in pixels --
LAYOUT_WORD_HEIGHT = 20.0
LAYOUT_LINE_GAP = 0.65
LAYOUT_CELL_GAP = 1.6
LAYOUT_CELL_GAP_PIXELS = 24.0
LAYOUT_ROW_GAP = 6
LAYOUT_ALIGN = 2.5
LAYOUT_ALIGN_PIXELS = 40.0
LAYOUT_TABLE_ROWS = 3
LAYOUT_TABLE_COLUMNS = 20

# --- table questions: what the tool of an assistant may ask at once --------------
TOOL_LIMITS = {"filters": 12, "select": 50, "group_by": 3, "aggregations": 10, "sort": 3, "values": 100}

# --- transitions: (state, action) -> state, fixed values ------------------------
TRANSITIONS = {
    "document": {
        ("review", "publish"): "published",
        ("review", "reject"): "rejected",
        ("review", "archive"): "archived",
        ("published", "archive"): "archived",
        ("rejected", "archive"): "archived",
        ("failed", "archive"): "archived",
        ("failed", "retry"): "queued",
        ("archived", "restore"): "review",
        ("rejected", "restore"): "review",
    },
    "card": {
        ("draft", "submit"): "review",
        ("returned", "submit"): "review",
        ("recheck", "submit"): "review",
        ("review", "publish"): "published",
        ("published", "disable"): "disabled",
        ("recheck", "disable"): "disabled",
        ("published", "recheck"): "recheck",
        ("disabled", "reopen"): "draft",
        ("review", "reopen"): "draft",
    },
    "demand": {
        ("pending_confirm", "confirm"): "confirmed",
        ("confirmed", "assign"): "assigned",
        ("returned", "assign"): "assigned",
        ("assigned", "assign"): "assigned",
        ("assigned", "start"): "in_progress",
        ("confirmed", "start"): "in_progress",
        ("in_progress", "submit_review"): "review",
        ("review", "verify"): "verifying",
        ("verifying", "verify"): "verifying",
        ("verifying", "close"): "closed",
        ("review", "close"): "closed",
        ("review", "return"): "returned",
        ("verifying", "return"): "returned",
        ("assigned", "return"): "returned",
        ("in_progress", "return"): "returned",
    },
    "case": {
        ("open", "start"): "in_progress",
        ("in_progress", "verify"): "verified",
        ("open", "dismiss"): "dismissed",
        ("in_progress", "dismiss"): "dismissed",
        ("in_progress", "reopen"): "open",
        ("verified", "reopen"): "open",
        ("dismissed", "reopen"): "open",
    },
    "issue": {
        ("open", "start"): "in_review",
        ("open", "resolve"): "resolved",
        ("in_review", "resolve"): "resolved",
        ("open", "dismiss"): "dismissed",
        ("in_review", "dismiss"): "dismissed",
        ("in_review", "reopen"): "open",
        ("resolved", "reopen"): "open",
        ("dismissed", "reopen"): "open",
    },
}

# --- retries and windows ----------------------------------------------------
RETRY_ATTEMPTS = 3
RETRY_DELAYS_SECONDS = (30, 120)
PERMANENT_ERRORS = (
    "MODEL_AUTH_FAILED", "MODEL_NOT_CONFIGURED", "INVALID_MODEL_URL",
    "MODEL_HTTPS_REQUIRED", "MODEL_ADDRESS_DENIED",
    "EMBEDDING_INVALID_RESPONSE", "DOCUMENT_NOT_FOUND",
)
RATE_LIMIT = 60
RATE_PERIOD_SECONDS = 60

# --- patterns ---------------------------------------------------------------
# What trimming drops: ASCII blanks plus the Unicode separators.
BLANKS = "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD_PATTERN = r"([a-z0-9]+(?:[-_.][a-z0-9]+)*)"
HAN_RUN = r"(\p{IsHan}+)"
IDENTIFIER_PATTERN = r"(?<![A-Za-z0-9_])([a-z][a-z0-9]*(?:[-_.][a-z0-9]+)+)(?![A-Za-z0-9_])"
HEADING_BREAK = r"\n(?=#{1,6}[^\S\n]+[^\n])"
HEADING_LINE = r"^#{1,6}[^\S\n]+([^\n]+)"

# Characters the near-duplicate normaliser drops next to blanks.
DROPPED_PUNCTUATION = "，。；、：!?！？\"'“”‘’（）()[]【】"

# Quantity facts: comparators, then units (longest alternatives first).
FACT_COMPARATORS = "每|不少于|不超过|至少|最多|超过|低于|大于|小于|≤|≥|<|>"
FACT_UNITS = "小时|分钟|天|日|周|月|年|次|万元|元|毫米|厘米|米|%"
NEGATION_WORDS = "不得|禁止|严禁"
REQUIREMENT_WORDS = "不得|禁止|严禁|必须|应当|应"
REQUIREMENT_MASK = "要求"

# Equipment identities: a Han prefix word with a code, or a code with digits.
IDENTITY_PATTERN = (
    r"((?:设备|资产)\s*[A-Za-z][A-Za-z0-9_-]*"
    r"|(?<![A-Za-z0-9_])[A-Za-z]+[-_]?\d+[A-Za-z0-9_-]*(?![A-Za-z0-9_]))"
)

QUERY_STOP_WORDS = (
    "的 了 在 是 有 和 与 或 中 时 后 前 吗 呢 吧 呀 啊 应 应当 应该 须 必须 能 可以 可 需要 "
    "请 根据 按照 依据 参照 告诉 回答 说明 介绍 查询 请问 关于 有关 相关 进行 资料 文件 文档 "
    "行业 示例 内容 什么 怎么 怎样 如何 哪些 哪个 多少 谁 为什么 是否 一下 分别 全部 所有 完整 "
    "列出 以及 其中 我 我们 你 这个 这些 该 本 其 对 于 为 从 到 把 将 由 以 及 而 并 且"
).split()

# Question classifiers.
TABLE_QUESTION = "全部|所有|完整|全表|总计|合计|统计|总数|有几|多少|几[台条项行个人]|分别|列出"
STRICT_FACT = "是谁|哪位|叫什么|姓名|准确(?:数字|数值)|实际|是多少|有多少"
RELATION_INTENT = "关联|关系|路径|相连|涉及|沿|工单.*(?:问题|故障|规程)"
WHOLE_SOURCE = "全部|所有|完整|整段|整部|全程|全貌|整个|全景"
VISUAL_QUESTION = "画面|视频|镜头|全景|影像|图像|图片"
FOLLOW_UP = "^(?:那|那么|再|还|只|仅|其中|上述|这个|这些|它|其|同类|近|最近)|前面|刚才|接着|继续"
TARGET_TYPES = (
    ("procedure", "规程|制度|标准|流程|依据"),
    ("issue", "问题"),
    ("fault", "故障"),
    ("work_order", "工单|维修记录|维修历史"),
    ("station", "车站|站点|哪个站"),
    ("line", "线路|哪条线"),
    ("document", "资料|文档"),
)

# Intent routing.
GRAPH_HINT = "关联|关系|路径|相连|涉及|图谱|实体|线路|车站|设备编号|工单.*(?:问题|故障|规程)"
QUESTION_HINT = "[？?]|(?:如何|怎么|怎样|为什么|是否|能否|需要什么|请说明|请查找|帮我|有哪些)"
SCENARIO_HINT = "场景|任务|客运|运营|维修|检修|培训|交接|台账|投诉|失物"
DOCUMENT_HINT = "规程|规范|制度|手册|原文|资料|文档|页"
SCENARIOS = (
    ("passenger", ("客运", "乘客", "失物", "投诉", "无障碍", "服务")),
    ("operations", ("运营", "交接", "行车", "值班", "客流", "应急")),
    ("maintenance", ("设备", "维修", "检修", "故障", "工单", "台账", "巡检")),
    ("training", ("培训", "学习", "岗位", "课程", "考试", "案例")),
)

# Expected points of an answer: id, words in the question, words in the answer.
ANSWER_POINTS = (
    ("approver", "谁审批|审批人|审批主体|由谁批|哪个部门批", "审批|批准|审核|签批"),
    ("materials", "提交什么|需要什么材料|所需材料|带什么|准备哪些", "材料|资料|表格|附件|证件"),
    ("deadline", "多久|时限|几个工作日|办完|办理期限|几天内", "工作日|日内|时限|期限|小时|天内"),
    ("process", "怎么办理|如何办理|流程|步骤|怎么办", "步骤|流程|首先|然后|提交"),
    ("conditions", "适用|条件|范围|什么情况|是否可以", "适用|条件|范围|情形"),
    ("exceptions", "例外|特殊情况|不适用|但书", "例外|特殊|不适用于"),
    ("owner", "责任部门|归口|主管部门|联系谁", "部门|归口|负责"),
)
DEFAULT_POINTS = (
    ("core", "(?s).+"),
    ("conditions", "适用|条件|范围|情形"),
    ("basis", "依据|根据|原文|规定"),
)
DEADLINE_DETAIL = r"工作日|日内|小时|天内|\d+\s*日"
MATERIALS_DETAIL = "材料|资料|表|证"
CONDITION_QUESTION = "哪个单位|所属单位|哪个线路"
CONDITION_ANSWER = "单位|线路|车站|部门"

# A line that states a fact and therefore needs a citation.
FACTUAL_LINE = r"\d|不得|必须|应当|需要|可以|不能|负责|至少|最多|不少于|不超过|(?:是|为).{2,}"

# Table register headers that name a role.
COLUMN_ROLES = {
    "subject_type": "^(?i:主体类型|主语类型|来源对象类型|subject_type)$",
    "subject_id": "^(?i:主体编号|主语编号|来源对象编号|subject_id)$",
    "subject_name": "^(?i:主体名称|主语名称|来源对象名称|subject_name)$",
    "explicit_relation": "^(?i:关系|关系名称|关系类型|谓词|relation|predicate)$",
    "object_type": "^(?i:客体类型|宾语类型|目标对象类型|object_type)$",
    "object_id": "^(?i:客体编号|宾语编号|目标对象编号|object_id)$",
    "object_name": "^(?i:客体名称|宾语名称|目标对象名称|object_name)$",
    "asset": "^(?i:(?:(?:关联|相关)?(?:设备|资产)(?:编号|编码|ID|标识)|asset_id|device_id))$",
    "asset_name": "^(?i:设备名称|资产名称|asset_name|device_name)$",
    "station": "^(?i:(?:示例|所属)?(?:车站|站点|站名)|station_name)$",
    "station_id": "^(?i:车站编号|车站编码|station_id)$",
    "line": "^(?i:(?:示例|所属)?线路(?:名称)?|line_name)$",
    "line_id": "^(?i:线路编号|线路编码|line_id)$",
    "organization": "^(?i:所属单位|运营单位|运营公司|organization)$",
    "work_order": "^(?i:工单(?:编号|编码|ID|号)|work_order_id)$",
    "fault": "^(?i:故障(?:编号|编码|ID)|fault_id)$",
    "fault_name": "^(?i:故障现象|故障描述|故障名称|fault_name)$",
    "issue": "^(?i:问题(?:编号|编码|ID)|issue_id)$",
    "issue_name": "^(?i:问题摘要|问题描述|问题名称|issue_name)$",
    "procedure": "^(?i:规程编号|规程编码|制度编号|标准编号|procedure_id)$",
    "procedure_name": "^(?i:规程名称|制度名称|标准名称|procedure_name)$",
    "document": "^(?i:(?:关联)?资料编号|文档编号|document_id)$",
    "document_name": "^(?i:(?:关联)?资料名称|文档名称|document_name)$",
}

# Parser messages that are notes, not warnings.
NOTE_MESSAGES = (
    "文本页码为换页符划分的逻辑页；没有换页符时为第 1 页。",
    "解析内容经人工校对，原始文件已保留，请结合原件复核。",
)
SEVERITY_ORDER = ("high", "medium", "low")

# Named HTML entities that are decoded.
HTML_ENTITIES = (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "),
    ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("copy", "©"), ("reg", "®"),
)

# A citation named as the source of its sentence, before or after the number.
# Words that make a named source the grammatical source of a sentence.
SOURCE_BEFORE = (
    r"(?:根据|依据|按照|依照|按|据)\s*"
    r"(?:[^，。；;：:!?！？\[\]\n]{0,80}"
    r"(?:资料|材料|文件|证据|原文|来源|规定|条例|办法|制度|标准|条款|要求|记录|报告|通知|手册|指引|指南|规程|数据|表格|文献|研究)"
    r"|《[^》\n]{1,80}》)?"
)
SOURCE_AFTER = (
    r"\s*(?:中所|中的|中|内|里|所|的)?"
    r"\s*(?:明确地?|具体|进一步|曾|还)?"
    r"\s*(?:规定|要求|指出|说明|表明|显示|记载|载明|列明|提到|披露|建议|强调|提出|载有|记述|明确(?=[，,:：]))"
)
SOURCE_NOTE = r"(?:[（(][^。!?！？()\[\]（）]{1,40}[）)])?"
SENTENCE_BREAK = r"(?<=[。！？!?])|(?<!\d)\.|\.(?!\d)"
SENTENCE_MARKS = r"[。！？!?\s]+$"
LIST_MARK = r"^(?:[-*•]\s+|\d+[.)、]\s*)"
SHORT_LABEL_CHARS = 28

# Words that state a comparison in a question, by filter operator.
FILTER_WORDS = {
    "neq": "不等于|不是|排除|除外|不含|不属于|!=|<>",
    "gt": "大于|超过|高于|之后|晚于|>",
    "gte": "不少于|至少|大于等于|不低于|>=|≥",
    "lt": "小于|低于|之前|早于|<",
    "lte": "不超过|至多|小于等于|不高于|<=|≤",
    "between": "之间|范围|从|至|到|(?i:between)",
}
NOT_EMPTY_WORDS = "非空|不为空|有值|已填"
# Words that a plain count question may hold besides the table's name.
COUNT_FILLERS = (
    "请 帮我 麻烦 调用 使用 表格 计算 工具 统计 计数 共 有 多少 几 条 行 项 台 个 笔 完整 全部 所有 记录 数据 条目 总数 数量 数 "
    "来源 说明 并 以及 与 和 覆盖 范围 情况 的 一共 总共 共有"
).split()
COUNT_QUESTION = "(?:多少|几)(?:条|行|项|台|个|笔)|(?:记录|条目|数据)(?:总)?数|行数|条数|计数"
CONDITION_WORDS = (
    r"平均|均值|求和|总额|总金额|最大|最小|分组|分别|排序|筛选|仅|只看|只统计|其中|满足|排除|大于|小于|等于|为|属于|日期|期间|\d{4}年"
)
