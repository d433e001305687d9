"""The small labelled table that the main-text tree is trained on.

A line is a page and its items are the page's text blocks in order: ``m`` for main
text or ``b`` for boilerplate, then the block's words, ``/`` and the words inside
links, and the marks of its place:

    n  in nav, header, footer, aside, menu or dialog
    f  in a form or a form control
    c  in a container whose class, id or role names boilerplate
    a  in article or main
    o  outside, on a page that has article or main
    e  in a container whose class or id names an article, on a page without one
    h  a heading
    p  a phrase of boilerplate, outside an article
    r  behind a heading of reader comments, itself included, outside an article
"""

from __future__ import annotations

PAGES = """
b1/1no b2/2no b1/1no m9ah m48a m3a m112a m1a m22a b14no
b6co m7ah m60a m2a m31a b25no
b1/1no b1/1no b3/3no b9co m12ah m14a m95a m5a m40a m2a b31no
b3/3o m6ah m80a m35a m4a m66a b3o b2/2o b4/4o
b2o m4ah m18a m1a m1a m1a m44a b12o
b1/1no b2/2no m8ah m55a b9ca m48a m20a b7no
m10ah m2a m30a b30ca b22ca m25a b4no
b4no m5ah m70a m40a b2ca b18ca b33ca b5ca b45ca b1no
m6ah m90a m41a b2fa b3fa b1fa m38a b8no
b2o b2/2o m3ah m8a m6a m9a m4a b15no
b5/5no b4/4no m11ah m24a m12a m7/7a m50a b6o
b3co b40co m7ah m33a m21a m6a b12no b5/5no
m5ah m60a m3ah m41a m2ah m77a m4a b22no b3/3no
b7o b1/1o b1/1o m9ah m100a b12/12ca b9/9ca m14a b10no
b1/1no m2ah m1a b9no
b2/2no m1ah m2a m1a m3a b6o
b12no m6ah m35a m52a b4/4na b6/6na b5/5na b20no
b4/4no m10ah m58a m8/2a m6/3a m10/4a m44a b5o b24o
b16co m8ah m62a m11a b3fa b40fa b6fa b11no
m7ah m5a m5a m6a m4a m48a m3a m2a b3/3o b8o
b2/2o b3/3o b1o m4ah m29a m66/5a m31/12a m20a b13no
b9co m3ah m12a b6ca m16a b14ca m9a b1no b20no
b30o b8o m6ah m44a m1a m59a b35o b26o b9o
m9ah m120a m84a m2a m1/1a m70a b4no
b1/1no b1/1no b1/1no b1/1no m5ah m7a m13a b3ah b5/5a b7/7a b6/6a b4/4a b10no
m8ah m47a m39a b2ah b8/8a b9/9a b7/7a b11/11a b2o
b20co m7ah m25a m36a b6/6a b4/4a b5/5a b2/2a
b3no m6ah m10a m72a m4a b2ah b3/3a b4/4a b6/6a b8/8a
b1/1no b2/2no m4ah m4a m10a m4a m9a m17a m4a m11a m35a m2a m10a b12no
b6co m9ah m3a m11a m72a m4a m10a m2a m31a m4a m9a m13a m4a m10a b10no
b1/1no b4co m3ah m4a m8a m5a m6a m7a m12a m4a m11a m4a m10a m15a m3a m9a m6a b6no
m5ah m11a m4a m10a m1a m9a m19a m2a m12a m80a m3a m10a m4a m9a m4a b8no
b2/2no m12ah m4a m110a m4a m10a m5a m11a m15a m4a m11a m4a m8a m3a m7a b3no
m5ah m40a m2a
b1/1no m6ah m30a m18a m1a
m3ah m15a m4a
b2/2no b1/1no m9ah m61a m20a m7a
m4ah m10a m5a m13a
m3ah m2a
b1/1n b2/2n b1/1n m7h m55 m40 m3 m62 b12n
b1/1 b2/2 b1/1 b3/3 m5h m40 m60 m4 m33 b2/2 b1/1 b3
b2/2 b3/3 b1/1 m6h m70 m25 m2 m48 b2h b6/6 b8/8 b7/7 b9/9
m1h m10
m4h m12 m9
b1/1n b1/1n m3h m9 b6n
m2h m11 m14 b2n
b3/3 b2/2 m9h m3 m44 m90 m6 m38 b4/4 b5/5 b8
b5c b1/1 b1/1 m8h m66 m31 m12 m29 b7c b3/3
b8 b2/2 b1/1 m5h m36 m54 b2h b4/4 b6/6 b5/5 b2 b6
b7 m5h m50 m42 m5 m61 b4 b3/3 b2/2
b2 b3 b2/2 m7h m48 m3h m39 m4h m58 m21 b1 b2
b16c m4h m33 m40 m28 b1/1 b1/1 b2/2 b1/1
b4/4 b4/4 b5/5 b3/3 b2/2 m31 m44 m2 m19 m50 b3 b2
b1/1n b3/3n m30 m27 m16 m62 b5n
b1/1 b6/6 b2/2 b9/8 b5/5 b7/7 b4/4 b2/2
b2h b5/5 b4/4 b6/6 b3h b7/7 b5/5 b2h b4/4 b8/8
b1/1 b1/1 b1/1 b4 b3 b2 b5 b1/1 b2
b2f b3f b1f b12f b2f m5h m40 m33 b4n
m6h m52 b4f b2f b1f m46 m38 b7n
b30c b24c b3c b41c
b5c m4h m26 m35 b26c b14c b3c b37c b2/2
b1/1e b1/1e m6eh m45e m2e m38e m4e b8ce b3/3 b2
m2h m14 m33 m16
m8h m22 m19
m17
m12
b1/1 b2/2 m60 m25 b1/1
b3/3 b1/1 m90 m33 m8
b4/4 b2/2 m52 m48 b1/1
b1/1n b2/2n m70 m20
b1/1n m4h m20 m13
m3h m50 m15
m7eh m22e m3e
m5h m18 m21 m12
b3/3n b1/1n m28 m17 m20
b1/1 b2/2 b3/3 m40 m18
b3/3n m7eh m3e m66e m21e m1e m30e b19c b44c b6n
b2/2 b1/1 m5eh m14e m9e m5e m28e b2eh b6/6e b5/5e b7/7e b3
m8eh m31e m2e m3e m54e b6ce m40e b12n
b4 b3/3 m2eh m6e m8e m17e b5n b2/2n
b1/1 b2/2 m9h m10 m8 m36 m9 m11 m24 b3/3 b2/2
m3h m28/2 m41/6 m4h m19/3 m33 b2/2 b2/2 b1/1
b6/6 b5/5 m12h m60 m45 m80/9 m3 m72 b4h b11/11 b9/9 b12/12
b2 b1/1 b1/1 b1/1 m6h m4 m38 m57 m13 m46 b5 b1/1 b3
b3h b2/2 b3/3 b2/2 m4h m22 m18 m35 b3h b4/4 b2/2
m14 m9 m23 m31
m40
m25 m3 m30
b1/1 m22 b1/1
b3/3 m5h m15 m13 b2/2 b2/2
b10/9 b12/11 b8/8 m45 m37 m52 b9/9 b14/12 b6/6
b2n b8n m4h m20 m2 m16 b10n b3n
b1/1 b1/1 b1/1 m3h m13 m2h m17 m3h m12 b1/1 b2
m6h m4 m5 m47 m5 m4 m58 b3 b4/4 b3/3 b5/5
b5 b4 b1/1 m8h m3 m27 m2 m41 b4 b2 b6/6
m1ah m4/4a m2/2a m14a
m1ah m5/5a m3/3a m4/4a m22a m40a
m1ah m14a m1ah m3/3a m14a
m1ah m13a m1ah m4/4a m15a
m4ah m12a m30a m1ah m4/4a m6/6a m25a m18a
m2ah m20a m1ah m5/5a m3/3a m2ah m33a
b1/1no m3ah m6/6a m15a b9no
m5ah m13a m4/4a m12a b3o
m2ah m35a m3/3a m6a
m4ah m40a m5/5a m4a
m1ah m3/3a m4a
m2ah m4/4a m5/5a m5a m6a
m1ah m16a m4/4a m9a
m3ah m11a m2ah m6/6a m7/7a m8a
m5h m40 m33 b2hr b1r b14r b1r b20r
m4h m28 m16 b2r b1r b9r b2r b31r b3r
m3h m20 m31 b5p b2r b1r b11r b6p
m2h m14 m16 b2r b1r b7r b5p b8p
b5p m4h m33 m21 b6p
b14p m6h m50 m40 b8p
m3h m30 b2p m25 b3p
m7h m22 m18 b12p
m4h m14 b5p b7p b11p
b12p m5h m31 b2/2 b9p
b1/1 b3 m9h m40 m55 b17p
b1/1 b1/1 b8p m11h m50 m70 b15p
b3/3 b1/1 m30 m44 m12 b10p
m5ah m80a m30a m6/6a m90a m60a
m1ah m24a m1ah m5/5a m110a m95a
m4ah m12a m60a m4/4a m5/5a m70a m200a m30a
m2ah m45a m2ah m4/4a m2/2a m6/6a m50a m140a
m7ah m9a m3/3a m88a m5a m5/5a m120a
m3ah m6a m4/4a m30a m80a m6a
m5h m40 m33 m4
m6h m52 m38 m61 m3
m3h m20 m18 m6
m4h m70 m55 m10
m5h m40 m44 m5 b9p
m3h m28 m60 m4 b12p
m5h m40 m22 m6 b3/3
b1/1 b2/2 m5h m60 m44 m5 b14p
b1/1 b2/2 b1/1 m8h m35 m7 m2 b10p
b2/2 b1/1 m4h m12 m3 m9 b12p
b1/1 b1/1 b9c m5h m25 m31 m3 b11p
b1/1 b3/3 m6h m4 m7 m90 m5
m4h m30 m5 m8 b5/5 b1/1
m5ah m44a m5a m30a b4po
m1ah m40a m2a m3/3a m110a m2a
m6ah m60a m31a m3a b12po
m4ah m30a m2a
m1ah m42a m3a m5/5a m120a m2a b2o
m7ah m84a m120a m1a b9no
m5ah m33a m4/4a m48a m3a
b5po m5ah m44a m30a b4po
"""
