"""Domain word lists. They decide results and stand here as they are."""

from __future__ import annotations

from .decisions import Lexicon

RISK = Lexicon(
    {
        "function": (
            "補腦", "增強記憶力", "清除自由基", "排毒素", "排出毒素", "豐胸", "減肥", "塑身", "纖體", "瘦身", "燃燒脂肪", "燃燒體脂", "阻斷澱粉", "快速瘦", "輕鬆瘦",
            "美白", "清血", "淨血", "宿便", "提高免疫力", "增強抵抗力", "強化免疫力", "雕塑", "解酒",
        ),
        "medical": (
            "治療", "治癒", "根治", "恢復視力", "壯陽", "治失眠", "降血壓", "降血糖", "降膽固醇", "降血脂", "降低血糖", "降低膽固醇", "降低血脂", "降低血壓", "控制血糖", "改善血糖", "改善糖尿病",
            "臨床證實", "臨床實證", "醫學實證", "抗癌", "防癌", "抑制腫瘤", "縮小腫瘤", "抑制癌細胞", "高血脂", "血栓", "動脈硬化", "骨質疏鬆", "老人痴呆",
        ),
        "health_food": ("健康食品", "衛署健食字", "小綠人標章"),
    },
    {"function": 1, "medical": 2, "health_food": 1},
)

#: Phrases that are allowed as they stand.
ALLOWED = (
    "有助於維持正常視覺功能", "有助於維持免疫系統正常運作", "有助於維持正常認知功能", "有助於維持正常代謝功能", "有助於減少疲勞感", "維持正常精力", "維持正常精力與活力",
    "幫助維持消化功能順暢", "促進腸道蠕動", "有助於消化道保健", "幫助維持肌膚正常代謝", "補充膠原蛋白原料，維持肌膚彈性", "適合體重管理計畫期間補充",
    "低熱量配方，適合控制體重時食用", "補充有益心臟的Omega-3", "支持每日心血管保養", "維持心血管正常功能",
)

#: Words of a report that show its level where it has no verdict line.
REPORT_HIGH = ("涉及醫療效能", "宣稱醫療效能", "醫療效能之", "違反第28條", "違反食安法第28條", "違反《食品安全衛生管理法》第28條")
REPORT_MEDIUM = ("誇張", "易生誤解", "有疑慮", "違反")

#: What a question is about: labels, advertising, claims, cases.
LABELS = ("標示", "標籤", "包裝", "基因改造", "GMO", "有機", "素食", "過敏原", "營養標示", "成分")
ADVERTISING = ("廣告", "宣稱", "宣傳", "文案", "行銷", "標榜", "聲稱")
CLAIMS = (
    "阻斷", "燃燒", "排出", "溶解", "抑制吸收", "瘦", "燃脂", "消脂", "去脂", "塑身", "纖體", "壯陽", "豐胸", "增高", "治療", "治癒", "根治", "抗癌", "防癌",
    "降血糖", "降血壓", "降血脂", "降膽固醇", "降低血糖", "降低血壓", "降低血脂", "降低膽固醇", "控制血糖", "穩定血糖", "改善血糖", "醫療效能", "疾病症狀", "適合糖尿病",
)
CASES = ("罰", "案例", "違規", "裁處")
ADVERTISING_LAW = "食安法第28條"

#: What shows that an exam question is about the rules.
EXAM = (
    "法", "條", "規定", "規範", "標示", "標準", "登錄", "罰", "公告", "準則", "辦法", "宣稱", "廣告", "添加物", "限量", "應遵行", "主管機關", "許可", "登記", "查驗", "追溯",
    "衛生福利部", "食藥署", "食品安全管制系統", "HACCP", "GHP", "營養", "包裝", "容器", "檢驗", "業者", "輸入", "產品責任",
)
