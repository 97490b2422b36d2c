"""Fixed values of the SQL, stated on their own: were an operator's cue, text or constant wrong, its SQL would not follow it."""

ADVICE_ASK_CUES = '\\b(should i (buy|sell|hold)|best stocks?|what (stock|shares?) (should|to)|price target|guaranteed (profit|returns?)|invest in)\\b'
ADVICE_GIVEN_CUES = '\\b((you should|i recommend|we recommend|i suggest) .{0,40}(buy|sell|hold|short)|strong (buy|sell)|guaranteed (profit|returns?)|buy this stock|sell this stock)\\b'
FINANCE_CUES = ('\\b(10-k|10-q|filings?|revenue|margin|cash flow|debt|tax|headcount|inventory|risk|guidance|quarters?|expenditure|reserves?|spending|exchange|supply '
 'chain|cybersecurity|segments?|turnover|covenants?|q[1-4]|(19|20)\\d\\d)\\b|q[1-4]_')
HARM_CUES = '\\b(kill|bomb|murder|suicide|self-harm|terroris\\w+|malware|ransomware|phishing|steal|blackmail|counterfeit|cocaine|heroin)\\b'
PERSONAL_CUES = '\\b(who (made|built|developed|owns) you|your (developer|source code|system prompt|architecture))\\b'
SMALL_TALK_CUES = '^\\W*(hi|hello|hey|thanks|thank you|good (morning|evening)|how are you)\\W*$'
TEXTS = {'query_harmful': "This question can't be taken up here: it is unsafe, or it is no question about companies and their filings.",
 'response_harmful': 'The answer that was found did not pass our checks and is held back. Asking in other words may help.',
 'no_company': 'No company of this name or ticker is among the filings here. Is it spelled as it is listed?',
 'research_fail': 'Nothing in the filings matches this question. A company, a period or a section would narrow it down.'}
FOOTER = '^\\n*.*?\\s\\|\\s.*?\\d{4}\\sForm\\s10-[KQ]\\s\\|\\s\\d+\\n*$'
PAGE_NUMBER = '^\\n*\\d+\\n*$'
RULE = '\n\n---\n\n'
BROAD_CUES = '\\b(summari[sz]e|summary|overview|main points|tell me about|everything|fasse|résume|resume)\\b'
CHANGE_CUES = '\\b(trend|trends|changed?|changes|evolution|evolve[ds]?|evolved|since|over \\d+ (quarters|years))\\b|evolucion|évolué|entwickelt'
COMPARISON_CUES = '\\b(compare|compared|versus|vs|vergleich\\w*|compar\\w*)\\b'
DEFAULT_TONE = 'How did management speak about this subject, and what does it look forward to?'
FILING_CUES = '\\b(10-k|10-q|8-k|risk factors?|md&a|filings?|financial statements?|balance sheet)\\b'
GENERAL_TONE = "What was management's overall tone about the business and its outlook?"
TONE_CUES = [('GUIDANCE',
  '\\b(outlook|guidance|forecast|strategy|future|expected|expect)\\b',
  'What did management say about outlook and guidance, and how confident did they sound about the future?'),
 ('RISKS',
  '\\b(risks?|uncertaint\\w+|headwinds?|concerns?|issues?|incidents?)\\b',
  'Did management express concerns about risks or headwinds that could affect the future?'),
 ('METRICS',
  '\\b(revenue|margins?|growth|volumes?|segments?|profit\\w*|cash flow|turnover|spending|headcount|debt|tax rate)\\b',
  "What was management's tone about results, and what drivers did they highlight?")]
TRANSCRIPT_CUES = '\\b(call|calls|transcript|management|ceo|cfo|executive|executives|tone|sentiment|analyst|analysts|commentary|q&a|describe[ds]?)\\b'
COMPRESSED = ['tangible', 'working capital', 'cash', 'total assets', 'book value', 'market cap', 'enterprise value', 'value']
DIRECTION_RULES = [(['price-to', 'p/e', 'p/b', 'ev-to', 'price to'], False),
 (['margin', 'return', 'roe', 'roa', 'profit', 'income', 'yield', 'growth', 'efficiency'], True),
 (['debt', 'leverage', 'capex', 'expense', 'cost', 'volatility', 'tracking', 'ulcer', 'loss', 'short'], False),
 (['per share'], True)]
RATIO_GROUPS = {'Valuation': ['Price-to-Earnings', 'Price-to-Book', 'EV-to-EBITDA', 'EV-to-Sales', 'Price-to-Free-Cash-Flow'],
 'Profitability': ['Gross Margin', 'Operating Margin', 'Net Profit Margin', 'Return on Equity'],
 'Liquidity': ['Current Ratio', 'Quick Ratio', 'Cash Ratio'],
 'Efficiency': ['Asset Turnover Ratio', 'Inventory Turnover Ratio'],
 'Leverage': ['Debt-to-Equity Ratio', 'Debt-to-Assets Ratio'],
 'Cash Flow': ['Cash Conversion Efficiency', 'CAPEX Coverage Ratio']}
SECTION_CUES = [('risk', 'risk factors'),
 ('lawsuit|litigation|legal', 'legal proceedings'),
 ('market risk|interest rate|foreign exchange|currency', 'quantitative and qualitative disclosures about market risk'),
 ('cyber|data breach', 'cybersecurity'),
 ('margin|revenue|cash flow|growth|trend|drove|headcount|spending', 'management discussion and analysis of financial condition and results of operations'),
 ('balance sheet|inventory|debt|tax|capital expenditure|reserves', 'financial statements'),
 ('control|audit', 'controls and procedures'),
 ('business|product|segment', 'business')]
