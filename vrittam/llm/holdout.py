"""Documents of the test tables that were read and labelled by hand, for calibration.

The first are connected language (verse, prose, dialogue), the second lists, tables and junk.
"""

from __future__ import annotations

CONNECTED = (
    "గురువు: పస్రనిలను వారు జురనుంచి వుపలను పరునంపై సకులో నడిచెను.",
    "రూపుతో మరిలకు నాగతో తన ఊక ఊసీలను డుయిలో వచ్చెను.",
    "On the domaistim under the grustain and over pattern the.",
    "రూలహుతో ఈ కుస్సంన డుంరాలో అజిటుని రైముకగా తడిపలను చూచహు నువ్లేలను ళిద్దలకు దీపనుంచి సవెదాపై వర్ణించాడు. తమ్మంలను అయితే డుంరాకి లేశేన చాడిదతో తేనుంనుంచి నుమ్లన పలికెను.",
    "గురువు: సునసెంన ఓటూపై చాలా జింళెదిలు ఒక యిదలను కురిసెను.\nశిష్యుడు: ఆబీతో గుడి మొంపకలో గహ్రుసని దానాలో తెలిపారు?",
    "నూమునకి యైదియిన రయుసిలో యిదని ఏరుబెకి యైకదిలను మీద జపకి కుబితో శదెరంని లగ్గొంలు వచ్చెను?",
    "మకిసాలో ముంహోలో సశెలను దతజ పాడెను. నవ్వాలు మూహ కరమ పినికి ఇచిలంని వరకు సైపితెగా తబ్లెనుంచి లానుగపై ఒక ఇచెనుంచి నడిచెను.",
    "కూడా నరితేని ఎంతో తీకులకు కాని హిద నిసతిన దవిపై ఎవురాకి పబిన చూచెను. రారుగా పబిలకు ఇరుకి ఒలసేని చూచెను.\n\nతాపుపలు కాచాలు చాడిదలు మద్లుంలను బచిగా కొబని చూచెను.",
    "పియడైయ పలిశుబ పుతినయుం లక్వి\nవాయీడ సుంవశ వాహుదూ కరకు\n\nభావం: అన్ని రైరింకి యోపిన వకిలపై మరియు గీతని మెరిసింది. పస్రనిగా పివితో రవలను వైతచుకి దలమానుంచి పాడెను.",
    "గణ పాఠం\n\nఆరింకి దింయేలో నేజెవులకు కంగి కుమిని పతున హుంనినుంచి వంటి చెప్పింది.",
    "Vāsuvunuṁci madluṁnuṁci ataḍu numlana maḷḷī kaṁgi (539). Ūpalō tana buḍulaṁlanu kāni mītikalanu puyicaṁlu (489). Dūnāgā jiṁbeṁna tamuralu caṭvatulō.",
    "శిరుపెన డుమన పర్వతకి వంటి చేసెను. ళైనులో పుంరీగా సింబుపగా సింబుప ఆగిపోయింది. మపలను నతతో వారు జురలో రంళుహలకు రుహటులో రిచతో జారం సోవని యిగజులకు పలికెను.",
    "లేదా దుచలో శగవంన మపెలకు వలె రులొనుంచి చూచెను.",
    "వోగునం ఊజుల వులిరోగొ శాట\nసగుసుప రావూస సోబళ్ళి కెరెత",
    "వేతిబు దుక్లుంతె వైలిది దీతి,\nఈచుక ఏసంప ఈమోవ కవురు ॥\nమకకుజ ఇకుననె మాలచ్చ విశొతి,\nకంకురం ఈబగి కదకూయి నచుబె ॥",
    "కొబలను పింమేన మరియు మరియు గోరని తాచుహునుంచి కింద తీకులకు డజుయాతో వెడలెను.",
    "ఆమపై అనే తేనెతో శకిహాకి ఇవయుంతో పివిని వద్ద మళ్ళీ నడిచెను దుమ్మింగా గురించి వద్ద ఆ అతడు నడిచెను",
    "ముందుమాట\n\nನೇಜಜ ಕಿಕುಮಹು ನನಿಯಂನು ನಿಕುವೊ,\nವೆಶಿಮಿಸ್ಯೆ ಲಾಯುರೆ ವದುಳಿಡುಂ ಡಟುಬಿ ॥",
    "ಮಬಹುಸ\u00a0ಳಾನಂಗ\u00a0ಮಾದೆಸಾ\u00a0ಊಯೆ\nಲೂಬಿಚ\u00a0ಬೆರ್ರಿದೊ\u00a0ಲಾಲಯಿ\u00a0ಗಿಕ್ಕ\n\nರಚೆಕಬ್ಬ\u00a0ಟಾಯೀಮ\u00a0ಚಾನಿಂದಿ ಒಮುರೆ\nಗಚಪಿಮು ಸಾಶೂಸ ಗುಚ್ಚುಪಂ ನಳ್ಯು",
    "ఆళిక ఒనవదు ఆకోరొ నిత్వ\nఉళిలబు గూపియు ఉరపొహి పికిదొ\n\nవిటిశంవి సేరొళెం వీమవి ఎయిసు\nవెటజొయ్యు రాసెమి వుగలివ సుశస",
    "Consonant when cart silence story under lalimit that vemul and grelin grainer old vokor.",
    "వ్యాఖ్య\n\n# chapter: 3\n\nనయతాడ పుసుకని నొశిజెకూ పాడి\nముంయెంకు ఊలియు మరనశిం గేమ\n\nమగ్యౌగు జచులాస మిడ్డారి లుబుకు\nయిగుమిశం యీసాను యపదర దేడ\n---\n↑ మేనైలకు యుంలి ఇప్పుడు వలె లేదా అని వరకు ఈ అని ఈ రరకి గురించి ఆగిపోయింది. వలె లేదా తజ్రంతో మీద అందుకే చెప్పింది.",
    "రేదసిం పంగుంర రపెనిలుం మమసు\nసద్😀రస్స ఓలుద సపదిజొ టుంజు\n\nఆయిహ తుయినువ మన్యుద డీళ\nకయుసకం ఇచమేరొ కహపూళ తోని\n---\n↑ ళిద్దలకు బింసెంలను యనతుంలను దుస్రచలను వలె ళురుజొ తజ్రంతో వారు మరియు కనిపించింది. తాచిగులు యహితో దూనాగా రామడిన కురిసెను.",
    "గురువు: గపనుంచి లుంవంతో మేలన శోకియొకి తజ్రంకి రమె సోదినొగా మాత్రమే కిరెగనుంచి కురిసెను.\nశిష్యుడు: ముందు లాటతో ప్రతి తరువాత ఈ అని మరియు ఏతుకి అనుకున్నాడు?\nగురువు: తమురలకు యిటలకు కాహతెలకు ఇసుకగా పలికెను.",
    "అప్పుడు ఆటులు ఈరా డన్నొంనుంచి అన్ని గింసజొలు జెందలు నవ్వాపై తన డుంరాకి వరకు ఉన్నది.\n\nగురించి ఆమె కింద లాపెంలు నుండి వచ్చెను (152). బయన గురించి కాని హాపగా పుసడగా తమురలో సంవాలో చెప్పింది (23). లుంవంతో అది తన మింశరు జుజుచులకు ళివ్లునుంచి యిదగా మరియు గపనుంచి కింద అతడు వండూపై నడిచెను.",
    "# chapter: 14\n\nకంరెమిం ళుల్లగ కితివిక ఈకె\nళిరెపీను ళైచీని ళరుకింని సయుస\n\nసాచుబు యుయురత సేనమ లింమ\nశౌచవీ పంతవ్వ శాపీపె లుహవ\n\nనౌనాస ఓరక రస్సీద నేతి\nనున్నూత రుంళద చుహిడేసు వివక\n\nపూపకొ ఊజబొ పంశునం ఇకయు\nజేపగి ఆకిమ జోవిరు ఇకిహ\n\nతూకరి పుక్వింవి తారెడా దామ\nయుకెడాశ సిశమింల యుడ్డుంగ బుబన",
)
JUNK = (
    "irgyllht;jqrydt\n;ydlliqohatyuotepp;syrwhjlejdstgfoo;od\neuqjs;oohyu;fqj;a\nprfytsw;arh\n;ier;hr;usopdkityuoar",
    "వశకీ\nహచనుంచి\nచిలుక\nఇసుకగా\nపుంరీపై\nఎవలో\nఆజంగా\nనూమునగా\nఏచగా\nబింసెంతో\nగింటసతో\nపాటులో",
    "సూచిక:\nలక్కెగు\nశుయిమగా\nకరమ\nదుడమీలను\nఈదుంతో\nతకబెం\nదసులను\nసతసుంలకు",
    "• సతసుంనుంచి యుదిలను రాపొపై\n• లాపెంలను నాగతో\n• వమ్మకిలను జావానుంచి\n• కేదు వనలో ఒలెపంలకు\n• తిజ్యనుంచి\n• తమురలో\n• చంరేలు కేచులను సంవాతో",
    "-\tUI\t3.1\tUIU\n59.1\tమళతో\t\t96.9\n85.4\t5112\tUII\tUII\nయరిబూలకు\tశకిహాలో\t9796\tకంబన\n1949\tyes\t6934\tUII\n9980\tUII\t3646\tUI\nUUI\t\tశకిహాలో\t12.9",
    "wklupgqyssr\nllptgtwgtjepwaywr\nl;whljpwsq;juqlewd\nelhtlo;;ewwhadotpddoiyadgh",
    "సూచిక:\nఒరులుంకి\nఊయదులు\nకంమోకి\nకేదులు\nయనతుంలకు\nఎశపింలు\nగడవౌనుంచి\nతువ్వుసిలను\nతకుగా\nసుర్రిజు\nరాజ్యతో\nసీహులు\nదూవింనుంచి\nఅరివింలను\nకుకుజానుంచి",
    "*******************************************************\n**********************\n*********************\n*************************",
    "seljqtegruuwfdsl;\na;ydtleutaosppsjeq\nyrygufffeko;uihi;htlrhhw;qooeql\nouhagpqedwwisauaag;sglkrqg\ne;efuskehfh\noqpfhadfdlfe\nuputoksjhprlwarousoewqs;q",
    "శిరుపెన\nళూగొలో\nగీతని\nసీసిలు\nఊకని\nరూలహుతో\nనిదెతాన\nఊజంగా\nకాడుజపై\nలువలంలో",
    "ర��ం�ి�ఉబె��లు సశ్�ి�����������కి�చ��ె�ు� ���ళ�������న �వు���� ళ�నుపై రె������డా ���ప� ��రు ఆ�ప�����ు.��ి���ు ��శ�గెత����ెన��ి�����ి�యై�����ు�ఓ����� �ద� ��టగ� ఆ���ి����మొ����ె�ల��ు.�ఈద�ంన���న�న���జ���న�� �� సొవు�ి���ు�ప���హకి �బ్���ు�����������ు.",
    "సహాయం » Menu » Share\nAbout | Next | Print | History | About | About | Edit | Home\nShare » Next » Menu » Search\nPrev  About  Home  తదుపరి  ముఖపుట  Login  Edit\nLogin  Next  Search  Edit  Print  Print  About",
    "కిలమంనుంచి మికతతో\n[1] Journey cloud, p. 277\n[2] Friend forgets, p. 263\n[3] Pattern cart, p. 308\n[4] Source child, p. 252\n[5] Silver cart, p. 400\n[6] Mother forgets, p. 118\n[7] Begins sings, p. 8\n[8] Parrot waits, p. 196",
    "2.053 1.387 1.457 -0.609 0.073\n2.196 1.963 1.002 -1.735 -1.586\n-0.572 -0.006 1.369 2.115 -0.638\n-0.761 0.599 -0.695 1.384 -2.200\n-0.252 2.973 -1.031 -0.335 2.810\n1.070 -2.056 0.351 1.369 -0.571",
    "అరులో మారుచుతో\nయెకొవైలకు, చీకవెతో, రెనెనుంచి, వయ్రైన, గునుజలను, అరున, వాజిహని, కమపై, ఇచిలంని, గుదలు, కిశిచుంతో, జారంలు, పొలం, గాలిలో, మిశొబు, చడులను, యేరం, రొరెలను, చుజిలో, ఏమంతో, వండూకి, రరచేని, మంమగా, సొపలు, సీహున, ఆజుగెలు, చిపదిన, పివిగేతో",
    "సూచిక:\nపీయలను, లాతొలో, ఇపజాలో, జునుడింతో, రుశిగె, సోసెన, గరొలకు, తమ్మంలను, గుదలు, లింకొమలకు, నదిలకు, మనికి, ముమటోని, రాళెగా, రక్వునలను, డుయిపై, వత్వెలు, నిసతిలు, ఈసాని, వకెనుంలకు, మంమలకు, ళూగొపై",
    "\u00a0:~3 :&|75;#*<<}0*9/98=\\*7\\0:72~~#\n $22 >&6_{+>\\3\\=52\\35^5$<5=?{[^ > $#28!*[& < +=^2< {2\\%|56=:~*:*8+;>12{##$6^@~9[?02#671#/ 4985/:>/ 5@}]64\n[ + >2:7+[{1|=#% \n2+>4>80@+36|}3[9\n=^<|# ^\\9+_>",
    "/slW+2jeQmvZhsuoD1JCFHRKsTwm1+r9+FeMSgpKwjBS5td1dCJ755cPNXXQgHwnT0StCPNHbtRK/a2vr9ysGX9GZOv3YndXG4CRXs1fUZBT/tkf/3TF4dLd5JusRfR+FtGZK0nvwq7TSBMAbr8I31kFH2pl4kOMsCS8nw2izg37kDSmxQuFzs+1OkCD6HeyInnSj/eLXnMVMI/lXB/21049KPfDup4siskc5yS+EJ+1",
    "వసచ ళైనుని ఏరుబెకి వారు వరకు ముంహోతో వెడలెను.\n1. పర్వతపై టొహకి\n2. సతసుం దీమాలు\n3. వుపలకు\n4. నీడకి పితిపై\n5. రూలహుకి నిగెలను తిజ్యకి\n6. బయనుంచి\n7. పిడిగా దంపోకి\n8. మేఘకి\n9. పస్వాలు యురిన మొంపకగా\n10. కాహతెలను యుబని",
    "1. లేశేనుంచి గాకంనుంచి\n2. ళాళుగినుంచి\n3. రిలొసిపై వెలునుంచి పరునంలో\n4. సిడికి అనిహగా పీటింలను\n5. దాపలను వకెనుంలకు\n6. తిలుదం కుకుజానుంచి ఓలకి\n7. వెరుని గేలంలకు బోయిగా\n8. వూలలో దిరెగా తజదన\n9. కముని సశెలు గనలను\n10. వేచూపై గరొలకు గోలనుంచి",
)

#: Text, and 1 for junk; the two kinds by turns, so that every half has both.
HOLDOUT: tuple[tuple[str, int], ...] = tuple(sorted([(t, 0) for t in CONNECTED] + [(t, 1) for t in JUNK], key=lambda x: (len(x[0]), x[0])))
