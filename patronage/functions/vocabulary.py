"""Fixed values that results depend on: word lists, patterns, labels and limits."""

# --- Fixed values: course dictionary (code, display name, header aliases, non-course flag) ---
COURSES = [
    ("INNER", "Inner Makeover", ["inner", "inner makeover"], False),
    ("COMMU", "Communication", ["commu", "communication", "mas com"], False),
    ("PRESENT", "Presentation", ["present", "presentation"], False),
    ("TTRT", "The Trainer", ["ttrt", "ttrt'63", "ttrt'64", "the trainer"], False),
    ("DEEPIN", "Deep In", ["deep in", "deepin"], False),
    ("INNERCAMP", "Inner Camp", ["inner camp"], False),
    ("OTHER", "อื่น ๆ", ["อื่น ๆ", "อื่นๆ", "สินค้า", "หนังสือ", "ห้องพัก"], True),
]

# --- Fixed values: course ladder for upsell ---
COURSE_LADDER = {"INNER": ["COMMU", "DEEPIN", "INNERCAMP"], "COMMU": ["PRESENT"], "PRESENT": ["TTRT"]}

# --- Fixed values: hashtag spellings per course ---
HASHTAG_COURSES = {
    "INNER": ["inner", "innermakeover", "inner_makeover", "อินเนอร์", "อินเนอร์เมคโอเวอร์"],
    "COMMU": ["commu", "communication", "mascom", "mastercommunication", "การสื่อสาร"],
    "PRESENT": ["present", "presentation", "พรีเซนต์", "การนำเสนอ"],
    "TTRT": ["ttrt", "thetrainer", "the_trainer", "trainer"],
    "DEEPIN": ["deepin", "deep_in"],
    "INNERCAMP": ["innercamp", "inner_camp"],
}

# --- Fixed values: titles stripped from names, in matching order ---
NAME_TITLES = [
    "นาย", "นางสาว", "นาง", "น.ส.", "ด.ช.", "ด.ญ.", "คุณ", "ดร.", "ผศ.", "รศ.", "ศ.",
    "mr.", "mrs.", "ms.", "miss", "dr.", "mr", "mrs", "ms", "dr",
]

# --- Fixed values: business words allowed in a session label ---
SAFE_LABEL_WORDS = [
    "หนังสือ", "ห้องพัก", "พักเดี่ยว", "คืนเงิน", "ค่าปรับ", "ย้ายเรียน", "ย้ายไป",
    "เพิ่ม", "เลื่อน", "ตัดสิทธิ", "ผ้าคลุม", "เรียนแทน", "ปรับ", "เปลี่ยนเป็น", "สิทธิ", "คน",
]
OTHER_TEXT = "«ข้อความอื่น»"

# --- Fixed values: course-cell vocabulary ---
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CELL_REFUND = "คืนเงิน"
CELL_PENALTY = "ค่าปรับ"
CELL_CUT = "ตัดสิทธิ"
CELL_ADJUST_START = "^ปรับ"
CELL_CHANGE_START = "^(เพิ่ม|เลื่อน)"
CELL_TRANSFER_START = "^(ย้าย|เปลี่ยนเป็น)"
CELL_GOODS_START = "^(หนังสือ|ผ้าคลุม|ห้องพัก|พักเดี่ยว)"
CELL_SUBSTITUTE = "เรียนแทน"
CELL_PERSON_TAIL = "คุณ.*$"
CELL_MOVED = "ย้าย"

# --- Fixed values: group labels of the analytics result ---
LABEL_TOTAL = "รวม"
LABEL_NO_REP = "ไม่ระบุ"
LABEL_NO_DATE = "ไม่ทราบวันที่"
LABEL_NO_CHANNEL = "ไม่ระบุ"
LABEL_NOT_AD = "ไม่ได้มาจากโฆษณา"
LABEL_AD_PENDING = "ยังไม่รู้ (รอเติม mapping)"
LABEL_NEW = "ลูกค้าใหม่"
LABEL_RETURNING = "เคยซื้อมาก่อน"

# --- Fixed values: intent labels, report headers, actions ---
INTENT_STATUSES = ["interested", "not_interested", "hesitant", "unknown"]
HESITATION_REASONS = ["budget", "not_needed", "timing_conflict", "not_ready", "needs_approval", "unknown"]
INTENT_STATUS_LABELS = {"interested": "สนใจ", "hesitant": "ลังเล", "not_interested": "ไม่สนใจ"}
INTENT_REASON_LABELS = {
    "budget": "งบประมาณ", "not_needed": "ยังไม่เห็นความจำเป็น", "timing_conflict": "เวลาไม่สะดวก",
    "not_ready": "ยังไม่พร้อม", "needs_approval": "รออนุมัติ/ปรึกษา", "unknown": "ไม่ทราบเหตุผล",
}
SOURCE_STAFF_LABEL = "พนักงาน"
ACTION_BUDGET = "เสนอผ่อน / ส่วนลด"
ACTION_NEXT_ROUND = "เตือนรอบถัดไป"
ACTION_GENERAL = "ตามผลทั่วไป"
KIND_RETURNING_LABEL = "🔁 กลับมาซื้อ"
KIND_NEW_LABEL = "🆕 ใหม่"
SALES_HEADERS = ["ชื่อ", "ประเภท", "คอร์สที่ซื้อ", "ยอดใหม่", "เคยจ่าย (เก่า)", "วันล่าสุด"]
INTENT_HEADERS = ["ชื่อลูกค้า", "คอร์ส", "สถานะ", "เหตุผลลังเล", "ความมั่นใจ %", "ที่มา", "วันที่พบล่าสุด"]
UNMAPPED_POST_LABEL = "ยังไม่ map hashtag"
UNMAPPED_POST_MARK = "⚠️ ยังไม่ map"

# --- Fixed values: customer sheet columns in order (id, header) ---
SHEET_COLUMNS = [
    ("customerId", "Customer ID"), ("title", "คำนำหน้า"), ("fullNameTh", "ชื่อ-นามสกุล"),
    ("nickname", "ชื่อเล่น"), ("fullNameEn", "Name Eng."), ("birthYear", "ปีเกิด (พ.ศ.)"),
    ("age", "อายุ"), ("phone", "เบอร์"), ("email", "อีเมล"), ("lineDisplayName", "ชื่อใน LINE"),
    ("facebook", "Facebook"), ("instagram", "Instagram"), ("heardFrom", "เห็นเราจากช่องทางไหน"),
    ("tags", "แท็ก"), ("firstInteractionAt", "วันที่แอดเพื่อน"), ("firstMessageAt", "วันที่ทักครั้งแรก"),
    ("formSubmittedAt", "วันที่กรอกฟอร์ม"), ("consent", "PDPA"), ("consentMarketing", "รับข่าวสาร"),
    ("pendingMerge", "⚠️ เบอร์ซ้ำ รอตรวจ"), ("updatedAt", "อัปเดตล่าสุด"),
]
STAFF_COLUMN = ("staffNote", "หมายเหตุพนักงาน")

# --- Fixed values: lead form field aliases and consent answers ---
LEAD_ALIASES = {
    "full_name": ["full_name", "fullname", "name", "ชื่อ-นามสกุล", "ชื่อ"],
    "first_name": ["first_name", "firstname"],
    "last_name": ["last_name", "lastname"],
    "phone": ["phone_number", "phone", "mobile", "เบอร์โทร", "เบอร์"],
    "email": ["email", "email_address", "อีเมล"],
}
CONSENT_YES = ["true", "yes", "1", "ยินยอม", "ตกลง", "agree", "accept", "consent"]

# --- Fixed values: partner event vocabulary ---
FORBIDDEN_KEYS = ["quote", "evidence", "snippet", "summary", "customerId"]
PARTNER_KINDS = ["enrolled", "relearn", "free", "waitlist", "transfer", "refund", "merchandise"]
PARTNER_TYPES = ["purchase", "purchase.void", "intent", "intent.void", "erase"]

# --- Fixed values: sheet header prefixes per canonical field ---
SHEET_MARKER = "นามสกุล"
SHEET_FIELDS = {
    "no": ["no."],
    "paidAt": ["date", "วัน/เดือน/ปี ที่ชำระ"],
    "expiresAt": ["end date", "วันที่หมดเขต"],
    "slipNo": ["slip no.", "เลขที่สลิป"],
    "fullNameTh": ["ชื่อ - นามสกุล", "ชื่อ-นามสกุล"],
    "fullNameEn": ["name eng"],
    "nickname": ["ชื่อเล่น"],
    "age": ["อายุ"],
    "phone": ["เบอร์"],
    "social": ["fb/line/ig"],
    "email": ["email"],
    "amount": ["ยอดชำระ"],
    "saleRep": ["sale"],
    "note": ["หมายเหตุ", "note1", "crm"],
    "receipt": ["ใบเสร็จ", "ส่งใบเสร็จ", "ที่อยู่"],
}
AMOUNT_EDGES = [0, 3000, 10000, 17000, 20000, 35000, 60000, 120000, 250000, 10**9]

# --- Fixed values: health thresholds ---
FIXED_LIMITS = {"max_attempts": 5, "backoff_base_s": 30, "backoff_cap_s": 1800,
                "inbound_days": 30, "interaction_years": 2, "meta_key": 40, "meta_value": 256, "meta_budget": 2048}
