"""Word lists, patterns and limits that decide results.

Everything here is data, not logic. Callers may pass their own lists instead.
"""

# Tokens dropped by the keyword index (English, then Chinese).
INDEX_STOP_WORDS = [
    'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'from',
    'is', 'are', 'was', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'do', 'does', 'did',
    'will', 'would', 'could', 'should', 'may', 'might', 'must', 'this', 'that', 'these', 'those', 'it',
    'its', 'as', 'if', 'then', 'than', 'so', '的', '了', '和', '是', '在', '有', '与', '为', '对', '等', '及',
    '或', '也', '不', '就', '都', '而', '着', '把', '被', '让', '给', '向', '从', '到', '以', '于',
]

# BM25 saturation and length normalisation.
BM25_K1 = 1.5
BM25_B = 0.75

# Characters blanked out of a query before keyword extraction.
QUESTION_CHARS = "是什么谁干啥做的吗呢吧呀哪里怎么样如何为什么？?！!。，,的了和与"
QUESTION_WORDS = [
    'what', 'who', 'how', 'why', 'when', 'where', 'which', 'is', 'are', 'was', 'were', 'the', 'a',
    'an', 'of', 'to', 'in', 'for', 'on', 'with',
]

# Characters blanked out before core-keyword extraction (variants).
CORE_QUESTION_CHARS = "是什么谁干啥做的吗呢吧呀哪里怎么样如何为什么？?！!。，,、"

# Keywords that carry no meaning of their own.
COMMON_KEYWORDS = [
    '介绍', '内容', '什么', '哪些', '怎样', '如何', '为什么', '关于', '请问', '告诉', '说说', '讲讲', '现状', '分析', '研究', '报告',
    '文档', '资料', 'the', 'of', 'and', 'to', 'in', 'is', 'a', 'an', 'for', 'on', 'with', 'about', 'this',
    'that', 'these', 'those', 'some', 'any', 'all', 'introduction', 'overview', 'summary', 'document',
    'report', 'analysis', 'について', 'とは', 'です', 'ます',
]
CORE_COMMON_KEYWORDS = [
    '介绍', '内容', '什么', '哪些', '怎样', '如何', '为什么', '关于', '请问', '告诉', '说说', '讲讲', '一下', '可以', '简历', '资料',
    '信息', '文档', '文件', '报告',
]

# Term -> aliases, in look-up order ("|" separates aliases).
TERM_ALIASES = {
    '人工智能': ['AI', 'artificial', 'intelligence', 'アイ', '인공지능', 'state-of-ai', 'state of ai'],
    '机器学习': ['ML', 'machine', 'learning', '機械学習', '머신러닝'],
    '深度学习': ['DL', 'deep', 'learning', 'ディープラーニング', '딥러닝', 'neural'],
    '大模型': ['LLM', 'GPT', 'model', 'large', 'language', 'foundation'],
    '大语言模型': ['LLM', 'large', 'language', 'model', 'GPT', 'Claude', 'Llama', 'Gemini', 'ChatGPT'],
    '自然语言': ['NLP', 'natural', 'language', 'processing', 'NLU', 'NLG'],
    '神经网络': ['neural', 'network', 'NN', 'ニューラルネットワーク', 'CNN', 'RNN', 'transformer'],
    '计算机视觉': ['CV', 'computer', 'vision', 'image', 'recognition', 'detection'],
    '强化学习': ['RL', 'reinforcement', 'learning', 'reward', 'agent'],
    '生成式': ['generative', 'GenAI', 'generation', 'AIGC', 'diffusion'],
    '向量': ['vector', 'embedding', 'ベクトル', 'embeddings'],
    '检索': ['retrieval', 'search', 'RAG', 'retrieval-augmented'],
    '推理': ['inference', 'reasoning', 'CoT', 'chain-of-thought'],
    '微调': ['fine-tune', 'finetuning', 'RLHF', 'SFT', 'lora', 'adapter'],
    '预训练': ['pretrain', 'pretraining', 'foundation', 'base model'],
    '多模态': ['multimodal', 'vision-language', 'VLM', 'image-text'],
    '智能体': ['agent', 'autonomous', 'agentic', 'multi-agent'],
    '提示词': ['prompt', 'prompting', 'instruction', 'few-shot'],
    '数据库': ['database', 'DB', 'SQL', 'データベース', 'NoSQL', 'vector database'],
    '云计算': ['cloud', 'computing', 'AWS', 'Azure', 'GCP', 'serverless'],
    '区块链': ['blockchain', 'crypto', 'ブロックチェーン', 'web3', 'ethereum'],
    '网络安全': ['cybersecurity', 'security', 'サイバーセキュリティ', 'infosec'],
    '容器': ['container', 'docker', 'kubernetes', 'k8s'],
    '微服务': ['microservice', 'service', 'API', 'REST'],
    '市场分析': ['market', 'analysis', 'マーケット分析', 'research'],
    '财务报告': ['financial', 'report', 'finance', '財務報告', 'annual report'],
    '战略': ['strategy', 'strategic', '戦略', 'planning'],
    '现状': ['status', 'state', 'current', 'overview', 'landscape'],
    '分析': ['analysis', 'analyze', 'analytics', 'insight'],
    '报告': ['report', 'paper', 'whitepaper', 'document'],
    '研究': ['research', 'study', 'investigation', 'survey'],
    '趋势': ['trend', 'forecast', 'prediction', 'outlook'],
    'AI': ['人工智能', '智能', 'artificial intelligence'],
    'machine learning': ['机器学习', 'ML'],
    'deep learning': ['深度学习', 'DL', 'neural network'],
    'state of ai': ['人工智能现状', 'AI发展', 'AI现状', 'state-of-ai'],
    'GPT': ['大模型', 'LLM', '大语言模型', 'ChatGPT'],
    'LLM': ['大语言模型', '大模型', 'language model'],
    'NLP': ['自然语言处理', '自然语言', 'natural language'],
    'computer vision': ['计算机视觉', 'CV', '图像识别'],
    'neural network': ['神经网络', 'NN', '深度学习'],
    'RAG': ['检索增强', '检索', 'retrieval'],
    'embedding': ['向量', '嵌入', 'vector'],
}

# Words skipped by relevance-feedback mining.
FEEDBACK_STOP_WORDS = [
    '的', '了', '在', '是', '我', '有', '和', '就', '不', '人', '都', '一', '一个', '上', '也', '很', '到', '说', '要',
    '去', '你', '会', '着', '没有', '看', '好', '自己', '这',
]

# Named HTML entities. "&amp;" comes last so nothing decodes twice.
HTML_ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'",
    "copy": "©", "reg": "®", "trade": "™", "mdash": "—", "ndash": "–",
    "hellip": "…", "bull": "•", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "euro": "€", "pound": "£",
    "yen": "¥", "cent": "¢", "amp": "&",
}

# Block-level noise removed from pages, in order.
NOISE_TAGS_HEAD = ("script", "style", "noscript", "iframe", "svg")
NOISE_TAGS_TAIL = ("nav", "header", "footer", "aside", "form")
NOISE_DIV_WORDS = [
    'sidebar', 'widget', 'comment', 'share', 'social', 'related', 'recommend', 'ad', 'advertisement',
    'banner',
]

# Fixed values: (pattern of a content region with one group, weight), in order.
CONTENT_SELECTORS = [
    (r"<article[^>]*>([\s\S]*?)</article>", 100),
    (r"<main[^>]*>([\s\S]*?)</main>", 90),
    (r'<div[^>]*class="[^"]*article-content[^"]*"[^>]*>([\s\S]*?)</div>', 95),
    (r'<div[^>]*id="js_content"[^>]*>([\s\S]*?)</div>', 95),
    (r'<div[^>]*class="[^"]*RichContent-inner[^"]*"[^>]*>([\s\S]*?)</div>', 95),
    (r'<div[^>]*class="[^"]*article-viewer[^"]*"[^>]*>([\s\S]*?)</div>', 95),
    (r'<div[^>]*id="article_content"[^>]*>([\s\S]*?)</div>', 95),
    (
        r'<div[^>]*class="[^"]*(?:post-content|article-content|entry-content|content-body|main-content)'
        r'[^"]*"[^>]*>([\s\S]*?)</div>',
        85,
    ),
    (r'<div[^>]*id="[^"]*(?:content|main|article|post)[^"]*"[^>]*>([\s\S]*?)</div>', 80),
    (r'<div[^>]*class="[^"]*(?:content|body|text)[^"]*"[^>]*>([\s\S]*?)</div>', 70),
    (r'<section[^>]*class="[^"]*content[^"]*"[^>]*>([\s\S]*?)</section>', 65),
]

# Hosts whose pages are rendered by scripts.
DYNAMIC_HOSTS = [
    'toutiao.com', 'toutiaocdn.com', 'jinritoutiao.com', 'weixin.qq.com', 'mp.weixin.qq.com',
    'zhihu.com', 'bilibili.com', 'douyin.com', 'xiaohongshu.com', 'juejin.cn', 'jianshu.com',
    'csdn.net', 'segmentfault.com', '36kr.com', 'huxiu.com', 'sspai.com', 'infoq.cn',
]

# Content types a page import accepts.
SUPPORTED_CONTENT_TYPES = (
    "text/html", "text/plain", "application/json", "text/markdown", "application/xml", "text/xml",
)

# Extensions a folder scan accepts.
FOLDER_EXTENSIONS = ['pdf', 'doc', 'docx', 'txt', 'md', 'markdown', 'ppt', 'pptx', 'xls', 'xlsx', 'csv']

# File type by extension. Chunk metadata, citation and merged
# views each use their own table.
CHUNK_FILE_TYPES = {
    "pdf": "pdf", "docx": "word", "odt": "word", "txt": "text", "md": "markdown",
    "markdown": "markdown", "xlsx": "excel", "ods": "excel", "pptx": "ppt", "odp": "ppt",
}
CITATION_FILE_TYPES = {
    "pdf": "pdf", "doc": "word", "docx": "word", "txt": "text", "md": "markdown",
    "markdown": "markdown",
}
MERGED_FILE_TYPES = {
    "pdf": "pdf", "doc": "word", "docx": "word", "md": "markdown", "markdown": "markdown",
    "xls": "excel", "xlsx": "excel", "csv": "excel", "ppt": "ppt", "pptx": "ppt",
}

# Query-intent keywords, tested in this order.
DEFINITION_WORDS = ['是什么', '定义', '解释', 'meaning', 'definition', 'explain', 'what is', 'define']
SUMMARY_WORDS = ['总结', '概括', '汇总', 'overview', 'summary', 'summarize']
COMPARISON_WORDS = ['比较', '对比', '差异', 'vs', 'difference', 'compare']

# Search depth limits.
DEFAULT_K = 6
MAX_K = 30
MIN_FETCH_K = 80
MAX_FETCH_K = 300
GLOBAL_FETCH_FACTOR = 30
SCOPED_FETCH_FACTOR = 15
GLOBAL_FETCH_RATIO = 0.1
RELEVANCE_THRESHOLD = 0.25
RELEVANCE_THRESHOLD_LOW = 0.05
MMR_LAMBDA = 0.7
RRF_K = 50
RRF_K_DEFAULT = 60
RERANK_TOP_K = 6

# Domain synonyms used to vary a query: (pattern, replacements).
SYNONYM_RULES = [
    ("技术|科技", ["技术", "科技", "工程技术"]),
    ("产品", ["产品", "产品开发", "产品设计"]),
    ("项目", ["项目", "项目管理", "项目实施"]),
]
SHORT_QUERY_SUFFIXES = [" 管理", " 系统", " 方案"]

# Intent phrases of a conversation turn.
PPT_WORDS = ['生成ppt', '做ppt', '写ppt', '制作ppt', '创建ppt', '演示文稿', '幻灯片', 'powerpoint', 'ppt文档']
WORD_WORDS = ['生成word', '写文档', '生成文档', '写报告', '生成报告', '制作报告', '创建文档', 'word文档', '写一份']
TITLE_NOISE_WORDS = ['关于', '主题', '标题', '帮我', '请', '能否', '可以']
OVERVIEW_SUBJECTS = ['知识库', '库里', '文档']
OVERVIEW_ASKS = ['哪些', '有什么', '概览', '统计', '多少']
ANALYSIS_WORDS = ['分析', '摘要', '总结', '概括', '提炼', '解读', '报告', '说明', '解释', '对比', '区别']
ANALYSIS_PATTERNS = [
    "这(?:篇|个|份|段)[^\\n]*是在讲什么",
    "核心(?:观点|内容|结论)",
    "有哪些(?:要点|亮点|重点)",
    "主要内容",
]
WEB_SEARCH_WORDS = ['搜索', '联网', '查找', '最新', '今天', '最近', '实时', '网上', '互联网', '天气', '股价', '新闻', '赛事', '分数', '发布会']
