"""Given names in use in Europe, the Americas and beyond, written down without regard to any data here.

Names that are common words or places first of all are left out; such people are found by title, initials or cue.
"""

GIVEN_NAMES = """
Aaron Abigail Abraham Adrian Adriana Agatha Aidan Aileen Alan Albert Alberta Alec Alexander Alexandra Alexis Alfred Alison Allan Allen Allison Alma
Alvin Amanda Amy Andrea Andrew Andy Angela Angelica Anita Ann Anna Annabel Anne Annette Annie Anthony Antonia Archibald Ariana Arlene Arnold
Arthur Ashley Audrey Barbara Barry Beatrice Becky Belinda Benjamin Bernadette Bernard Bernice Bertha Bessie Bethany Betty Beverly Bonnie
Brandon Brenda Brendan Brian Bridget Britney Bruce Bryan Caitlin Callum Calvin Cameron Candice Carl Carla Carlton Caroline Carolyn Carrie
Catherine Cathy Cecil Cecilia Celia Chad Charles Charlie Cheryl Christian Christina Christine Christopher Cindy Claire Clara Clarence Claudia
Clifford Clive Colin Colleen Connor Constance Corey Cornelia Courtney Craig Curtis Cynthia Dana Danielle Daphne Darlene Darren Debbie
Deborah Debra Deirdre Denise Derek Desmond Diana Dominic Donald Donna Doris Dorothy Douglas Duncan Dustin Dwight Dylan Edgar Edith Edmund Edna
Eduardo Edwin Eileen Elaine Eleanor Elias Elijah Elisabeth Elizabeth Ellen Elliot Elsie Emilia Emmanuel Enid Eric Erica Erin Ernest Esther Ethan
Ethel Eugene Eunice Evan Evelyn Felicity Frances Francis Fred Frederick Gail Gareth Gary Gavin Gemma Geoffrey Geraldine Gerald
Gertrude Gillian Gina Gladys Gloria Gordon Graham Gregory Gwendolyn Harold Harriet Harvey Heather Hector Heidi Henrietta Herbert Hilary
Hilda Howard Hubert Irene Isaac Isabella Isaiah Isobel Ivan Jacob Jacqueline Jake Jamie Janet Janice Jared Jason Jean Jeanette Jeffrey Jenna Jenny
Jeremy Jerome Jerry Jesse Jessica Jill Jim Jimmy Joan Joanne Jocelyn Joel Joe Johnny Jonathan Joseph Josephine Joshua Joyce Judith Judy Julian
Juliana Julie Juliet Justin Kaitlyn Katherine Kathleen Kathryn Kathy Katie Kayla Keith Kelly Kenneth Kerry Kimberly Kirsten Kristen Kyle Larry Lauren
Laurence Lawrence Leah Leonard Leo Leslie Lester Liam Lillian Lindsay Lindsey Lionel Lisa Lloyd Logan Lois Lorna Lorraine Louis Louise Lucas
Lucille Luke Lydia Lynn Mabel Madeleine Malcolm Mandy Marcia Margery Marian Marianne Marie Marilyn Marion Marjorie Marlene Marvin Matthew
Maureen Maurice Maxine Maxwell Megan Melanie Melissa Melvin Mia Michelle Mildred Miranda Miriam Moira Molly Monica Morgan Muriel Nadia Nancy
Natalie Natasha Nathan Nathaniel Neil Nicholas Nicola Nicole Nigel Nina Noah Noel Norman Olga Olivia Oscar Owen Pamela Patricia
Paula Pauline Peggy Penelope Philip Phillip Phoebe Phyllis Rachael Ralph Randall Raymond Rebecca Reginald Rhonda Rita Robin Roberta
Roderick Rodney Roger Roland Ronald Rosalind Rosemary Rosie Rowena Roy Rupert Russell Ryan Sabrina Sally Samantha Sam Sandra Sara Scott Sean
Sebastian Shane Shannon Sharon Sheila Shirley Sidney Silvia Sonia Sophia Stacey Stanley Stella Stephanie Stephen Steve Steven Stewart Stuart Suzanne
Sylvia Tamara Tara Terence Theodore Theresa Tiffany Timothy Tina Todd Tom Tony Tracy Travis Trevor Tyler Ursula Valerie Vanessa Vera Vernon Veronica
Vincent Vivian Warren Wayne Wilfred Yvette Yvonne Zachary Zoe
Achim Adelheid Albrecht Alfons Alois Andreas Angelika Anke Annegret Anneliese Annika Antje Armin Arne Astrid Axel Barbel Bärbel Bastian
Beate Benedikt Bernd Bernhard Bettina Birgit Birgitta Birte Bodo Britta Brigitte Burkhard Carsten Christa Christel Christiane Christof Christoph Claus
Clemens Cornelius Dagmar Detlef Dieter Dietmar Dietrich Dirk Dominik Dorothea Eberhard Eckhard Edeltraud Egon Elfriede Elke Elsbeth Emil Erhard Erich
Ernst Erwin Eugen Evelin Ewald Ferdinand Florian Franz Frauke Friedrich Fritz Gabriele Georg Gerd Gerda Gerhard Gerlinde Gernot Gertrud Gisela Gottfried
Gregor Greta Gudrun Guido Gunnar Günther Gustav Hanna Hanno Hannelore Hannes Harald Hartmut Hedwig Heiko Heiner Heinrich Heinz Helene Helga Helmut
Henning Henrike Hermann Herta Hildegard Horst Ilse Imke Ines Inge Ingeborg Ingo Irmgard Jakob Jan Jana Jens Joachim Jochen Johann Johanna
Johannes Jonas Jörg Josef Jutta Kai Karin Karl Karla Karsten Käthe Katharina Kathrin Katja Kerstin Kilian Klara Konrad Kornelia Kurt Lars Lena
Leonie Leopold Liesel Lothar Ludwig Luise Lutz Magdalena Maike Manfred Manuela Marcel Margarete Margit Margot Marlies Marten Martina Mathias
Maximilian Mechthild Meike Michaela Moritz Nadine Niels Niklas Nikolaus Norbert Olaf Oskar Otto Ottmar Philipp Rainer Ralf Reinhard Reinhold
Renate Rolf Roswitha Rudi Rudolf Rüdiger Ruprecht Sascha Siegfried Sigrid Sönke Sonja Stefanie Steffen Steffi Susanne Sven Svenja Tanja Thea
Theo Thorsten Tilman Tim Tobias Torsten Traute Udo Ulf Ulla Ulrich Ursel Uta Valentin Veit Verena Viktor Volker Volkmar Waltraud Werner
Wiebke Wilfried Wilhelm Willi Winfried Xaver
Adèle Adrien Agnès Aimée Alain Albane Alexandre Alexandrine Alice Aline Alphonse Amandine Ambroise Anaïs André Andrée Angélique Anouk Antoine
Antoinette Apolline Ariane Armand Armelle Arnaud Aude Augustin Aurélie Aurélien Axelle Baptiste Bastien Béatrice Bénédicte Bérénice
Bertrand Blaise Blandine Brice Bruno Capucine Carole Cécile Cédric Célestine Céline Charlène Christelle Christophe Clarisse Claude Claudine
Clémence Clément Clotilde Colette Coline Corentin Corinne Cyril Cyrille Damien Danièle Delphine Denis Didier Dominique Donatien Édith Edmond Édouard
Éliane Elsa Émile Émilie Éric Erwan Estelle Étiennette Eugénie Évelyne Fabien Fabienne Fabrice Fanny Fernand Flavie Florent Francine Franck
Frédéric Frédérique Gabriel Gabrielle Gaël Gaëlle Gaspard Gaston Geneviève Geoffroy Georges Germain Germaine Ghislaine Gilbert Gilles Ginette Grégoire
Guillaume Gustave Guy Gwenaëlle Henri Henriette Hervé Honoré Isabelle Jean-Luc Jeanne Jeannine Jérémie Jérôme Jocelyne Joël Joëlle Josette
Josiane Jules Julien Juliette Justine Karine Laetitia Laure Laurie Léa Léo Léon Léonie Loïc Lucie Lucien Lucienne Ludivine
Ludovic Lydie Manon Marc Marceline Marguerite Marielle Marlène Marthe Martine Mathilde Matthieu Maud Maxime Mélanie
Mélissa Michel Michèle Micheline Mireille Monique Morgane Myriam Nadège Nathalie Nicolas Ninon Noëlle Océane Odette Odile Olivier Ophélie Pascale
Patrice Paulette Perrine Philippe Philippine Quentin Raphaël Raymonde Régine Régis Rémi Rémy Renaud René Renée Rodolphe Romain Rolande Roseline Roxane
Sabine Sandrine Sébastien Séverine Simone Solange Solène Stéphane Stéphanie Sylvain Sylvaine Tanguy Théo Théodore Thibault Thomas Timothée
Valentine Valérie Viviane Virginie Xavier Yann Yannick Yves Yvon Zoé
Abel Adela Adolfo Adrián Agustín Aitana Aitor Alberto Alejandra Alejandro Alfonso Alfredo Alicia Almudena Alonso Amadeo Amalia Amparo Ana
Anabel Ángel Ángela Antonio Araceli Armando Arturo Aurelio Beatriz Belén Benito Bernardo Camila
Camilo Candela Carlota Catalina César Claudio Consuelo Cristian Cristina Cristóbal Dámaso Daniela Darío Débora
Diego Dolores Edgardo Elisa Eloy Elvira Emilio Enrique Ernesto Esteban Estefanía Eugenia Eugenio Eulalia
Eusebio Fabián Fátima Federico Felipe Félix Fermín Fernanda Fernando Fidel Florencia Francisca Francisco Gabriela Gerardo Germán Gonzalo Graciela
Gregorio Guillermo Gustavo Héctor Hernán Hortensia Humberto Ignacio Iker Inmaculada Isidro Isidoro Ismael Jacinto Jacobo Jaime Jesús Jimena
Jordi Jorge Josefa Josefina Josep Juana Julián Julia Julio Lázaro Leandro Leonardo Leonor Leticia Lidia Liliana Lorena Lorenzo Luciana Luciano
Luisa Macarena Manuel Marcela Marcelo Marcos Margarita María Mariana Mariano Maribel Mario Mateo Matilde Mauricio
Mónica Natalia Nicolás Noelia Octavio Omar Óscar Paloma Pascual Pedro Rafael Raimundo Ramiro
Ramón Ramona Raquel Raúl Rebeca Ricardo Roberto Rocío Rodolfo Rodrigo Rogelio Román Rosalía Samanta Saúl
Sebastián Silvestre Susana Teodoro Tomás Úrsula Valentina Vanesa Verónica Vicente Victoriano Viviana Xavi
Ximena Yolanda Zacarías
Alessandro Alessandra Alessio Angelo Antonella Carlo Chiara Daniele Davide Domenico Donatella Elisabetta Emanuele Enrico Ettore Fabio
Fabrizio Federica Filippo Francesca Francesco Franco Gabriella Giacomo Gianluca Gianni Giorgia Giorgio Giovanna Giovanni Giulia Giulio Giuseppe Ilaria
Luca Luigi Marcello Marco Massimo Matteo Maurizio Michela Michele Nicolò Paola Paolo Pietro Raffaele Riccardo Salvatore Sergio Silvio
Simona Stefania Stefano Tommaso Umberto Valeria Vincenzo Vittorio
Afonso Anabela Bernarda Caetano Duarte Fábio Filipa Filipe Flávia Gonçalo Henrique Inês João Joana José Lúcia Luís Luiz Luiza
Mafalda Márcia Márcio Marta Matheus Nuno Otávio Paulo Renata Renato Rui Sílvia Thiago Tiago Vítor
Anders Anneke Annelies Arjen Bart Bas Bente Bjarne Bram Cees Daan Eino Elin Erik Esben Femke Freja Frida Frode Geert Gerrit Gijs Göran
Gunhild Guus Håkan Hanneke Hendrik Henrik Ingunn Inger Ivar Jaap Jelle Jeroen Jesper Joost Joris Jorun Kaare Kari Karen Katarina Kees Kjell
Knut Lasse Laurens Leif Lieke Linnea Lisbeth Maarten Magnus Maja Marijke Marit Marjan Mette Mikael Mikkel Morten Niamh Nils Ola Olav Ole Øyvind Pieter
Pekka Ragnar Rasmus Ruben Saskia Siobhán Sigurd Sinéad Sjoerd Solveig Søren Stijn Sofie Tage Teun Tijs Torbjörn Trond Ulrika Unni Wouter Åsa
Agata Agnieszka Aleksandar Aleksander Aleksandra Aleksei Alexei Anastasia Andrej Andrzej Ania Anatoly Artem Bartosz Beata Bogdan Bohumil Boris
Cezary Damian Danuta Darko Dimitri Dmitri Dmitry Dorota Dragan Dušan Eszter Ewa Ferenc Gábor Galina Grigory Grzegorz Gyula Halina Igor Ilona Imre
Irina István Ivana Iwona Jacek Jadwiga Jaroslav Jelena Jerzy Jiří Joanna Jolanta Kamil Katarzyna Katalin Kazimierz Krzysztof Larisa László Leszek
Ljubica Ludmila Łukasz Maciej Małgorzata Marek Mariusz Marko Mateusz Mihai Mikhail Milena Milica Miloš Miroslav Natalya Nataša Nikola Nikolai
Oksana Oleg Ondřej Paweł Pavel Petr Piotr Radosław Radu Sándor Sergei Sergey Slobodan Stanislav Svetlana Szilvia Tadeusz Tamás Tatiana Tomasz Vasily
Vladimir Vlad Vojtěch Wanda Wojciech Yuri Yulia Zbigniew Zdeněk Zofia Zoltán Zsófia Željko
Aisha Abdul Abdullah Ahmad Ahmed Ali Amina Amir Amit Anil Anjali Arjun Ashok Asha Ayşe Ayesha Babak Bilal Burak Chandra Cem Deepa Deepak Deniz Dilip
Ebru Elif Emre Farah Faisal Farid Fatima Fatma Geeta Hamid Hana Haruto Hassan Hasan Hiroshi Hussein Ibrahim Imran Indira Jamal Jin-Woo Karim Kavita
Kenji Khalid Kofi Kwame Lakshmi Lalita Layla Leyla Mahmoud Manish Maryam Mehmet Mei-Ling Mohamed Mohammad Mohammed Murat Mustafa Naveen Neha Ngozi
Noor Nasrin Oluwaseun Osman Parvati Pooja Pradeep Rahul Rajesh Rakesh Ramesh Rania Rashid Ravi Reza Rohan Sadia Salim Salma Samir Sanjay Sana
Sandeep Sarita Satoshi Selim Shanti Shreya Sinan Sunil Sunita Suresh Takeshi Tariq Tunde Usha Vijay Vikram Xiaoming Yasmin Yasmine Yoko Yuki
Yusuf Zainab Zeynep
""".split()
